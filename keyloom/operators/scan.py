"""Full scans: aggregate, update in place, erase, statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def for_each(table: DataFrame, aggregates: Mapping[str, str], carried: Mapping[str, object] | None = None, replicas: int = 1) -> DataFrame:
    """One row of aggregates over the table; carried parameters are columns in the expressions.

    The logical table is scanned once.  ``replicas`` above 1 counts every physical copy.
    """
    rows = table.withColumns({k: F.lit(v) for k, v in (carried or {}).items()}) if carried else table
    if replicas > 1:
        rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(replicas))))
    return rows.agg(*[F.expr(e).alias(c) for c, e in aggregates.items()])


def for_each_with(table: DataFrame, partial: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, merge: Mapping[str, str]) -> DataFrame:
    """Arbitrary scan: ``partial`` makes a few rows of each partition, ``merge`` aggregates them."""
    return table.mapInPandas(partial, schema).agg(*[F.expr(e).alias(c) for c, e in merge.items()])


def update(table: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """The table with values replaced by expressions of the row."""
    return table.withColumns({v: F.expr(e) for v, e in values.items()})


def erase_if(table: DataFrame, predicate: str) -> DataFrame:
    """The rows for which the predicate is not true (null keeps a row)."""
    return table.where(~F.coalesce(F.expr(predicate), F.lit(False)))


def statistics(table: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """shard_id, item_number, and with a layout a row for each node that holds the shard."""
    counts = table.groupBy("shard_id").agg(F.count("*").alias("item_number"))
    if layout is None:
        return counts
    return layout.select("node_id", "shard_id").join(counts, "shard_id", "left").select("node_id", "shard_id", F.coalesce("item_number", F.lit(0)).alias("item_number"))
