"""What the operators of this package share: tables, folds, the shared scratch folder and Arrow batch sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship

#: Rows, and bytes, of texts that go to a Python worker at once; a longer text goes alone.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20
#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """For operators with Python functions: sends this package to the workers, and bounds Arrow batches in rows and bytes, for the session."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def fold(id_col: Column | str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in fold 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds, F.lit(0))


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for a local master that names none."""
    conf = spark.sparkContext.getConf()
    if found := spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None) or spark.conf.get("keyloom.scratch.dir", None):
        return found
    if not conf.get("spark.master", "").startswith("local["):
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_keyloom_scratch"
    else:
        found = "file://" + tempfile.mkdtemp(prefix="keyloom-")
    spark.conf.set("keyloom.scratch.dir", found)
    return found


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: computed once, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, y) of at most ``limit`` labelled documents outside fold 0, chosen by a hash of the id.

    The ids chosen are a table of at most ``limit`` rows, so it is broadcast.  Rows with a null key or label are left out.
    Rows equal in id, text and label count once; if rows that share an id still make more than ``limit``, a hash of id and text
    chooses among them.
    """
    h = F.xxhash64(F.lit("labelled"), F.col(key))
    ids = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(key) != 0)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"), h.alias("h"))
    n = ids.count()
    if n > limit:
        u = F.shiftrightunsigned(F.col("h"), 11) / float(1 << 53)
        ids = ids.where(u <= 1.2 * limit / n).orderBy("h", "k", "y").limit(limit)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids), "k")
    rows = materialize(rows.select("text", "y", F.xxhash64("k", "text", "y").alias("h")).dropDuplicates(["h"]), "labelled")
    return bounded(rows, limit).select("text", "y")


def unlabelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """text of at most ``limit`` documents outside fold 0 that have no such label, chosen by a hash of id and text."""
    told = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("k")).distinct()
    rows = docs.where(F.col(key).isNotNull() & (fold(key) != 0)).select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"), F.xxhash64(F.lit("unlabelled"), key, text).alias("h"))
    n = rows.count()
    if n > limit:
        # Twice the share, since labelled ones go; what is over goes by the bound.
        rows = rows.where(F.shiftrightunsigned(F.col("h"), 11) / float(1 << 53) <= 2.0 * limit / n)
    rows = materialize(rows.join(told, "k", "left_anti").select("text", "h").dropDuplicates(["h"]), "unlabelled")
    return bounded(rows, limit).select("text")


def bounded(rows: DataFrame, limit: int) -> DataFrame:
    """The rows of the ``limit`` smallest hashes h, which are distinct; only hashes are sorted."""
    if rows.count() <= limit:
        return rows
    last = rows.select("h").orderBy("h").limit(limit).agg(F.max("h").alias("h")).first().h
    return rows.where(F.col("h") <= last)


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
