"""Upserts: items are combined per key, pending pushes folded, and the result merged into the stored rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spec import MergeSpec


def combine(items: DataFrame, keys: list[str], merge: MergeSpec) -> DataFrame:
    """One row for each key of a batch of items; partial aggregation keeps duplicates from the shuffle."""
    return items.groupBy(*keys).agg(*[F.expr(e).alias(c) for c, e in merge.combine.items()])


def packages(*batches: DataFrame) -> DataFrame:
    """Several item sets pushed in one call."""
    return reduce(DataFrame.unionByName, batches)


def fold(pending: DataFrame, keys: list[str], merge: MergeSpec) -> DataFrame:
    """One row for each key of any number of pending combined pushes."""
    return pending.groupBy(*keys).agg(*[F.expr(merge.merge_of(c)).alias(c) for c in merge.combine])


def upsert(base: DataFrame, pushed: DataFrame, keys: list[str], values: list[str], merge: MergeSpec, carried: list[str] | None = None) -> DataFrame:
    """The stored rows after a combined push: init for new keys that are accepted, store for known ones, others unchanged.

    ``carried`` columns depend on the key only and are taken from either side.
    """
    carried = carried or []
    b = base.select(*keys, *values, *carried).withColumn("__b", F.lit(True)).alias("base")
    p = pushed.withColumn("__p", F.lit(True)).alias("push")
    joined = b.join(p, [F.col(f"base.{k}").eqNullSafe(F.col(f"push.{k}")) for k in keys], "full_outer")
    joined = joined.where(F.col("__b").isNotNull() | F.expr(merge.accept))
    new, untouched = F.col("__b").isNull(), F.col("__p").isNull()
    key_cols = [F.when(new, F.col(f"push.{k}")).otherwise(F.col(f"base.{k}")).alias(k) for k in [*keys, *carried]]
    kinds = {f.name: f.dataType for f in base.schema}
    value_cols = [
        F.when(new, F.expr(merge.init_of(v))).when(untouched, F.col(f"base.{v}")).otherwise(F.expr(merge.store_of(v))).cast(kinds[v]).alias(v)
        for v in values
    ]
    return joined.select(*key_cols[: len(keys)], *value_cols, *key_cols[len(keys) :])


def upsert_small(base: DataFrame, pushed: DataFrame, keys: list[str], values: list[str], merge: MergeSpec, carried: list[str]) -> DataFrame:
    """The same for a push that the caller knows to be small: it is broadcast, and stored rows stay where they are."""
    kinds = {f.name: f.dataType for f in base.schema}
    on = lambda x, y: [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in keys]
    p = F.broadcast(pushed.withColumn("__p", F.lit(True))).alias("push")
    stored = base.select(*keys, *values, *carried).alias("base").join(p, on("base", "push"), "left")
    store = [F.when(F.col("__p"), F.expr(merge.store_of(v))).otherwise(F.col(f"base.{v}")).cast(kinds[v]).alias(v) for v in values]
    stored = stored.select(*[F.col(f"base.{k}") for k in keys], *store, *[F.col(f"base.{c}") for c in carried])
    # At most as many keys as the push has.
    known = base.select(*keys).alias("base").join(F.broadcast(pushed.select(*keys)).alias("push"), on("base", "push"), "left_semi").alias("known")
    new = pushed.alias("push").join(F.broadcast(known), on("push", "known"), "left_anti").where(F.expr(merge.accept))
    return stored.unionByName(new.select(*keys, *[F.expr(merge.init_of(v)).cast(kinds[v]).alias(v) for v in values], *carried))


def overwrite(base: DataFrame, rows: DataFrame, keys: list[str], values: list[str], seq: str | None = None) -> DataFrame:
    """Direct push: rows replace stored ones; of several rows of a key the one with the highest ``seq`` counts."""
    if seq:
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("v")).select(*keys, *[F.col(f"v.{v}").alias(v) for v in values])
    else:
        rows = rows.dropDuplicates(keys)
    return upsert(base, rows.select(*keys, *values), keys, values, MergeSpec({v: f"first({v})" for v in values}))


def push_with(base: DataFrame, items: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """A merge rule that SQL can't express: ``fn(key, stored rows, items)`` per key, as pandas frames."""
    return base.groupBy(*keys).cogroup(items.groupBy(*keys)).applyInPandas(fn, schema)
