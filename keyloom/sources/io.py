"""Dump, load and restore of key-value rows in text, JSON, CSV, ORC or Parquet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "json", "orc", "csv", "text")


def dump(rows: DataFrame, path: str, fmt: str = "parquet", files: int | None = None, compression: str | None = None) -> None:
    """Writes rows to a new folder; ``text`` is one JSON object a line.  ``files``: at most so many files, by shard."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    if files is not None and files < 1:
        raise ValueError("files is at least 1")
    if files and "shard_id" in rows.columns:
        rows = rows.repartition(files, F.pmod("shard_id", F.lit(files)))
    elif files:
        rows = rows.repartition(files)
    if fmt == "text":
        rows = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    writer = rows.write.mode("errorifexists")
    (writer.option("compression", compression) if compression else writer).format(fmt).save(path)


def read(spark: SparkSession, path: str | list[str], fmt: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a dump; the schema is given, never inferred."""
    if fmt == "text":
        kind = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
        return spark.read.text(path).select(F.from_json("value", kind).alias("r")).select("r.*")
    return spark.read.schema(schema).format(fmt).load(path)


def project(rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """File rows to table rows: result column -> expression."""
    return rows.select(*[F.expr(e).alias(c) for c, e in columns.items()])


def restore(base: DataFrame, rows: DataFrame, keys: list[str], shards: list[int] | None = None, on_duplicate: str = "keep_first") -> DataFrame:
    """base with the rows of the given shards inserted where their key is absent; known keys stay or raise."""
    if on_duplicate not in ("keep_first", "error"):
        raise ValueError("on_duplicate is keep_first or error")
    if shards is not None:
        rows = rows.where(F.col("shard_id").isin(shards))
    rows = rows.select(*base.columns)
    if on_duplicate == "error":
        both = base.unionByName(rows)
        twice = both.groupBy(*keys).count().where("count > 1")
        if not twice.isEmpty():
            raise ValueError("a restored key is in the table already, or twice in the files")
        return both
    return base.unionByName(rows.dropDuplicates(keys).join(base, keys, "left_anti").select(*base.columns))


def file_plan(layout: DataFrame, files: int) -> DataFrame:
    """node_id, shard_id, file_id: the file of each node's shard."""
    return layout.select("node_id", "shard_id", F.pmod("shard_id", F.lit(files)).alias("file_id"))


def pages(table: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The table with ``page``, its rows in key order cut into pages of a shard."""
    from pyspark.sql import Window

    w = Window.partitionBy("shard_id").orderBy(*keys)
    return table.withColumn("page", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
