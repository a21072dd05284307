"""Long vectors in a state table: one row for each slice of a fixed width, a property of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dense
from ..operators.spec import MergeSpec, TableSpec
from .table import StateTable


class DenseTable:
    """Vectors by key; pushes are added element by element, at once (async) or at the next store (sync)."""

    def __init__(self, table: StateTable, width: int):
        self.table, self.width = table, width

    @classmethod
    def create(cls, spark: SparkSession, root: str, width: int, key: str = "bigint", element: str = "bigint", shards: int = 8) -> DenseTable:
        add = dense.sum_parts(width)
        spec = TableSpec({"key": key, "slice_id": "int"}, {"part": f"array<{element}>"}, shards, "pmod(xxhash64(key) ^ cast(slice_id as bigint), {n})")
        merge = MergeSpec({"part": add}, {"part": add}, store={"part": "zip_with(base.part, push.part, (x, y) -> x + y)"})
        return cls(StateTable.create(spark, root, spec, merge), width)

    def push(self, vectors: DataFrame, mode: str = "async", batch_id: str | None = None, query: str = "") -> DenseTable:
        """vectors: key, vector.  Several vectors of a key are added up; all of a key have one length."""
        parts = dense.slices(vectors, "key", "vector", self.width)
        return DenseTable(self.table.push(parts, mode, batch_id, query), self.width)

    def store(self) -> DenseTable:
        return DenseTable(self.table.store(), self.width)

    def pull(self, keys: DataFrame, expected: Column | None = None) -> DataFrame:
        """key, vector of the requested keys; a key that the table lacks, or one with a missing slice, raises."""
        found = keys.select("key").distinct().join(self.table.df(), "key", "left")
        got = dense.gather(found.where("slice_id is not null"), "key", expected)
        absent = found.where("slice_id is null").select("key", F.raise_error(F.concat(F.lit("no vector of key "), F.col("key").cast("string"))).cast(got.schema["vector"].dataType).alias("vector"))
        return got.unionByName(absent)

    def changes(self, after: int, upto: int | None = None) -> DataFrame:
        raise NotImplementedError("vectors have no change feed")
