"""Keys to shards."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jump_buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach) of 64-bit keys: growing n moves only 1/n of the keys, all to new buckets."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    bucket, at = np.full(len(key), -1, dtype=np.int64), np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = at[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (bucket[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(float))
        at[live] = step.astype(np.int64)
        live = live[at[live] < n]
    return bucket


def jump(hashed: Column, n: int) -> Column:
    """Bucket of a 64-bit hash."""

    @F.pandas_udf("int")
    def bucket(h: pd.Series) -> pd.Series:
        return pd.Series(jump_buckets(h.to_numpy(), n).astype(np.int32))

    return bucket(F.coalesce(hashed.cast("long"), F.lit(0).cast("long")))


def shard_column(keys: Mapping[str, str] | list[str], n: int, partitioner: str = "jump") -> Column:
    """shard_id of a row, from its key columns."""
    cols = [F.col(k) for k in keys]
    if n == 1:
        return F.lit(0)
    if partitioner == "jump":
        return jump(F.xxhash64(*cols), n)
    if partitioner == "modulo":
        return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    return F.expr(partitioner.format(n=n)).cast("int")


def slice_shard(hashed: Column, slice_id: Column, n: int) -> Column:
    """Shard of a slice of a long vector: plain modulo of the key's hash with the slice mixed in."""
    return F.pmod(hashed.bitwiseXOR(slice_id.cast("long")), F.lit(n).cast("long")).cast("int")


def with_shards(df: DataFrame, keys: Mapping[str, str] | list[str], n: int, partitioner: str = "jump") -> DataFrame:
    return df.withColumn("shard_id", shard_column(keys, n, partitioner))
