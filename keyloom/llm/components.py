"""Connected components of a distributed edge table, by alternating large-star and small-star steps.

Edges never come to the driver; each round is written to the shared folder, and a count and a checksum of it tell whether
the next round is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """edges (a, b) -> (id, component): the smallest id that each id in an edge reaches.  Null ends are left out."""
    kind = edges.schema["a"].dataType
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    before = None
    while True:
        check = now.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("s")).first()
        if (check.n, check.s) == before or not check.n:
            break
        before = (check.n, check.s)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.v).where(both.b > both.a).select(both.b.alias("a"), "m").distinct()
        low = large.groupBy("a").agg(F.min("m").alias("m0")).withColumnRenamed("a", "v")
        small = large.join(low, large.a == low.v).where(large.m != low.m0).select(large.m.alias("a"), "m0")
        now = materialize(small.unionByName(low.select(F.col("v").alias("a"), "m0")).withColumnRenamed("m0", "b").distinct(), tag)
    leaves = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id").cast(kind))
    return leaves.unionByName(roots)
