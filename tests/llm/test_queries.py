"""Registered queries and the pipeline on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from keyloom.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
TABLE = {"op1": "pages", "op9": "embeddings"}


def rows(frame):
    text = lambda v: "" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    table = TABLE.get(name.split("_")[0], "documents")
    assert len(got) == spark.read.parquet(f"{DATA}/{table}.parquet").count()
    if name in entry.oracle_sql():
        con = duckdb.connect()
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
        assert rows(got) == rows(con.sql(entry.oracle_sql()[name]).df())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    before, sizes = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, DATA)
        assert i == len(corpus_pipeline.STAGES) - 1 or after.columns == before.columns
        docs = spark.createDataFrame(after.collect(), after.schema)
        sizes.append(docs.count())
        if i == 0:
            kept = {r.doc_id for r in docs.collect()}
            assert all(labels[d] for d in labels if d not in kept) is False and sum(d in kept for d in labels if labels[d]) >= 0.99 * sum(labels.values())
    assert sizes[0] < before.count() and sizes[2] < sizes[1] and sizes[4] == sizes[3]
    assert entry.queries()["pipeline"](spark, DATA).count() == sizes[4]


def test_rows_of_one_id_are_documents_of_their_own(spark):
    one, two, three = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(1, one), (1, two), (1, two), (1, ""), (2, two + " more"), (3, one), (3, three), (None, three), (0, "few words")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.keep_distinct(spark, docs, DATA).collect()), key=str)
        assert got == sorted([(1, one), (1, two), (1, ""), (3, three), (0, "few words")], key=str)


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with names that operators use."""
    good = "In the house there was light. The river ran on.\nAnd the walk was green, and the house was there."
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, good, "en", "a", len(good)), (3, good, "en", "a", len(good)), (4, good + " more words of it", None, None, 1)]
    rows += [(5, "word " * 20_000, "en", "b", 100_000), (None, good + " without any id at all", "en", "b", 9), (6, "12 34 !!", "en", "b", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return docs.withColumns({c: F.lit(c) for c in ("id", "k", "size", "cut", "h", "key", "place", "component_id", "label", "ids", "score")})


@pytest.mark.parametrize("at", range(5))
def test_stages_on_odd_documents(spark, at):
    name, stage = corpus_pipeline.STAGES[at]
    docs = odd_documents(spark)
    out = stage(spark, docs, DATA).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    if at < 3:  # filters keep rows whole
        assert {tuple(r) for r in out} <= {tuple(r) for r in docs.collect()}
    if name == "language ID":
        assert not {r.text for r in out} & {None, "", "12 34 !!"}
    if name == "n-gram Jaccard join":
        assert sum(r.doc_id == 3 for r in out) == 1 and sum(r.doc_id in (1, 2) for r in out) == 2
    if name == "BPE encoding":
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(queries.vocabulary())
        assert sorted((str(r.doc_id), r.ids) for r in out) == sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in texts)
    assert stage(spark, docs.limit(0), DATA).count() == 0
