"""Documents to token ids: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs.  All
but the last return the columns of documents.  Models are learned from each stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import bpe_codec, jaccard_join, language_id, mixing, quality
from keyloom.llm.common import fold, materialize, prepare, table
from keyloom.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality is below the threshold."""
    prepare(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.udf()(F.col("text")) >= quality.THRESHOLD)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language the margin leaves open."""
    prepare(spark)
    model = language_id.train(docs, where=fold("doc_id") != 0)
    return docs.where(~model.udf()(F.col("text"))["rejected"])


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies (five words, similarity 0.8).

    Rows that share an id are documents of their own: they are grouped by their texts, and those of one id are in the order
    of hashes of text and row.
    """
    prepare(spark)
    key, rows = "doc_id", docs
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        key = "__row"
        order = [F.asc_nulls_last("doc_id"), F.xxhash64("text"), F.xxhash64(*docs.columns)]
        rows = materialize(docs.orderBy(*order).withColumn(key, F.monotonically_increasing_id()), "pipeline-rows")
    found = materialize(jaccard_join.jaccard_components(rows, key), "pipeline-components")
    gone = found.where(F.col(key) != F.col("component_id")).select(key)
    if gone.count() <= jaccard_join.BROADCAST_IDS:
        gone = F.broadcast(gone)
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents until each source has its share of words."""
    mixed = mixing.mixed_copies(docs, mixing.mix_sources(docs))
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of what they decode to."""
    prepare(spark)
    return bpe_codec.encode_digests(docs, vocabulary(), with_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("n-gram Jaccard join", keep_distinct),
    ("mixing sources", mix),
    ("BPE encoding", encode),
]

#: The quality and language models can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
