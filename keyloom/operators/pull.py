"""Batched lookups: one output row for each requested position, a default for keys that the table lacks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Requests for at most so many distinct keys may be broadcast to the table's partitions.
BROADCAST_KEYS = 1_000_000


def pull(table: DataFrame, request: DataFrame, keys: list[str], defaults: Mapping[str, str], fetch: Mapping[str, str] | None = None, small: bool = False) -> DataFrame:
    """The request's columns and, for each name in ``defaults``, the stored value or the default (an SQL expression).

    ``fetch`` maps result names to expressions of the stored row (default: the column).  The table's key is unique, so
    duplicate keys of the request need no extra step: each position finds its row in the same join.
    ``small``: the caller expects few distinct keys; up to BROADCAST_KEYS of them are broadcast, more take the ordinary join.
    """
    fetch = fetch or {}
    side = table.select(*keys, *[F.expr(fetch.get(v, f"`{v}`")).alias(f"__{v}") for v in defaults], F.lit(True).alias("__hit"))
    if small:
        wanted = request.select(*keys).distinct()
        if wanted.count() <= BROADCAST_KEYS:
            side = side.join(F.broadcast(wanted), keys, "left_semi")
    out = request.join(side, keys, "left")
    return out.select(*request.columns, *[F.when(F.col("__hit"), F.col(f"__{v}")).otherwise(F.expr(d)).alias(v) for v, d in defaults.items()])


def packages(requests: Sequence[DataFrame]) -> DataFrame:
    """Several requests as one, with pkg_id: the number of the request."""
    return reduce(DataFrame.unionByName, [r.withColumn("pkg_id", F.lit(i)) for i, r in enumerate(requests)])


def missing(table: DataFrame, request: DataFrame, keys: list[str], defaults: Mapping[str, str]) -> DataFrame:
    """Rows that a pull with insert-on-miss adds: requested keys that the table lacks, with default values."""
    return request.select(*keys).distinct().join(table, keys, "left_anti").select(*keys, *[F.expr(d).alias(v) for v, d in defaults.items()])


def pick_replica(layout: DataFrame, request_id: int = 0) -> DataFrame:
    """shard_id, node_id: one replica for each shard, the same for the same request id."""
    return layout.groupBy("shard_id").agg(F.min_by("node_id", F.xxhash64("shard_id", "node_id", F.lit(request_id))).alias("node_id"))


def require_replicas(layout: DataFrame, shards: int) -> None:
    """Raises if a shard has no replica."""
    have = {r.shard_id for r in layout.select("shard_id").distinct().collect()}  # a row for each shard
    if lost := sorted(set(range(shards)) - have):
        raise RuntimeError(f"no replica for shards {lost}")
