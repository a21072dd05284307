"""Long vectors stored as slices of a fixed width, keyed by (key, slice_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slices(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """key, slice_id, part: one row for each ``width`` entries; an empty vector has none."""
    n = F.ceil(F.size(vector) / width).cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return df.select(key, F.col(vector), F.explode(ids).alias("slice_id")).select(key, "slice_id", F.slice(vector, F.col("slice_id") * width + 1, F.lit(width)).alias("part"))


def add(a: Column, b: Column) -> Column:
    """Element-wise sum."""
    return F.zip_with(a, b, lambda x, y: x + y)


def sum_parts(width: int, part: str = "part") -> str:
    """SQL of the element-wise sum of parts of at most ``width`` entries: a sum for each entry, so parts are added before the shuffle."""
    return f"filter(array({', '.join(f'sum(get(`{part}`, {i}))' for i in range(width))}), x -> x is not null)"


def merge_slices(pushes: DataFrame, key: str, width: int) -> DataFrame:
    """Element-wise sum of all pushed parts of each slice."""
    return pushes.groupBy(key, "slice_id").agg(F.expr(sum_parts(width)).alias("part"))


def upsert_slices(base: DataFrame, pushed: DataFrame, key: str) -> DataFrame:
    """Stored slices after adding pushed ones; new slices are copied."""
    both = base.select(key, "slice_id", F.col("part").alias("a")).join(pushed.select(key, "slice_id", F.col("part").alias("b")), [key, "slice_id"], "full_outer")
    return both.select(key, "slice_id", F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(add(F.col("a"), F.col("b"))).alias("part"))


def gather(stored: DataFrame, key: str, expected: Column | None = None) -> DataFrame:
    """key, vector: the slices of each key in order.  A key with a missing slice (a gap, or fewer than ``expected``) raises."""
    got = stored.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slice_id", "part"))).alias("s"))
    size = F.size("s")
    whole = F.element_at(F.col("s.slice_id"), -1) == size - 1
    if expected is not None:
        whole = whole & (size == expected)
    vector = F.flatten(F.col("s.part"))
    return got.select(key, F.when(whole, vector).otherwise(F.raise_error(F.concat(F.lit("missing slice of key "), F.col(key).cast("string")))).alias("vector"))
