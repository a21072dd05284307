"""The operators bound to the driver's tables: one query for each, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, cap_dedup, class_lm, fingerprint, jaccard_join, language_id, mixing, quality, toxicity, url_filter
from .common import fold, prepare, table

URL_RULES = [
    url_filter.host_path_rule("com", "/", "allow"),
    url_filter.host_path_rule("example.com", "/en/", "block"),
    url_filter.host_path_rule("www.example.com", "/en/", "allow"),
    url_filter.host_path_rule("net", "/es/", "block"),
    url_filter.host_path_rule("net", "/fr/", "block"),
    # The method's own rules, for URLs that none of the above fits.
    url_filter.GlobRule(".+spam-farm*", "block"),
    url_filter.GlobRule(".+cheap-pills*", "block"),
    url_filter.GlobRule(".+casino*", "block"),
    url_filter.GlobRule("*/*.exe", "block"),
    url_filter.GlobRule("*/login/*", "block"),
]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return bpe_codec.read_vocabulary(public_tokenizers.path(name))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("pattern")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), model.udf()(F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, where=fold("doc_id") != 0)
    found = docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), model.udf()(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.margin", "p.rejected")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = class_lm.score_documents(table(spark, sf_dir, "documents"), fold("doc_id") != 1)
    return found.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return cap_dedup.dedup_vectors(table(spark, sf_dir, "embeddings")).withColumn("component_id", F.col("component_id").cast("long"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe_codec.encode_digests(table(spark, sf_dir, "documents"), vocabulary())


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), model.udf()(F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_toxicity": op2_toxicity,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_mixing_sources": op4_mixing_sources,
    "op5_language_id": op5_language_id,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": r"""
with r as (select page_id, case when url is not null and strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
u as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
m as (select page_id, host, path, case
        when ('.' || host) like '%.www.example.com' and starts_with(path, '/en/') then 'www.example.com/en/'
        when ('.' || host) like '%.example.com' and starts_with(path, '/en/') then 'example.com/en/'
        when ('.' || host) like '%.com' and starts_with(path, '/') then 'com/'
        when ('.' || host) like '%.net' and starts_with(path, '/es/') then 'net/es/'
        when ('.' || host) like '%.net' and starts_with(path, '/fr/') then 'net/fr/' end as rule from u)
select page_id, host, path, rule, case
    when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block'
    when rule is not null then 'allow'
    when host || path <> '' and (regexp_matches('.' || host || path, '(?s)^\.[^/]*(spam-farm|cheap-pills|casino)') or path like '%.exe' or ('.' || host || path) like '%/login/%') then 'block'
    else 'allow' end as verdict
from m""",
    "op4_mixing_sources": r"""
with s as (select doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                  ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as h from documents),
t as (select source, sum(size)::bigint as source_size, 1 + (row_number() over (order by source is null, source) - 1) % 3 as w from s group by source),
c as (select *, 3 * source_size as cap, row_number() over (order by 3.0 * source_size / w, source is null, source) as k,
             sum(source_size) over () as total, sum(w) over () as all_w from t),
d as (select *, (total - coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0))::double
                / (all_w - coalesce(sum(w) over (order by k rows between unbounded preceding and 1 preceding), 0)) as level from c),
e as (select *, coalesce(min(case when w * level <= cap then k end) over (), 1000000000) as stop from d),
g as (select source, source_size, case when k < stop then cap::double else least(w * max(case when k = stop then level end) over (), cap::double) end as target from e),
p as (select s.doc_id, s.size, g.source_size, g.target, floor(g.target + 0.5)::bigint as budget,
             sum(s.size) over (partition by s.source order by s.h, s.doc_id nulls last, s.text rows between unbounded preceding and current row)::bigint as run
      from s join g on s.source is not distinct from g.source)
select doc_id, size, source_size, target,
       (case when source_size > 0 then budget // source_size else 0 end * size
        + greatest(0, least(size, budget - case when source_size > 0 then budget // source_size else 0 end * source_size - (run - size))))::bigint as taken
from p""",
}
