"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

Every word shingle (five words, lower-cased) is hashed, and every hash below a fixed fraction of the hash range is kept.
Sketches of parts merge by union, and two sketches of very unequal size still estimate how much of the smaller text the
larger one holds, because the same shingles are kept in both.  Of texts with at most ``ALL`` shingles every hash is kept: two
of them compare exactly, and against a longer one only their hashes below the threshold count.

A fingerprint is text: the hash of all words, ``:``, and the kept hashes in ascending order, joined by ``.``.  Texts with
the same words have the same fingerprint.  Likeness is 1 for equal word hashes, else the sketches' Jaccard estimate (0
when both sketches are empty).  A text with fewer than five words is one shingle; null counts as empty and has none, and
empty texts are alike (1).  Keys are numbers, dates or timestamps; others raise, since ranges of them can't be estimated.  Long texts are sketched whole.  Repeated rows: each keeps its own row.  Empty tables give
empty results.  Only id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions

WIDTH = 5
#: One hash in so many is kept.
SCALE = 8
#: Texts with so many shingles at most (repeated ones count) keep all hashes.
ALL = 64
#: Id ranges for each shuffle partition, in which the order of documents is established.
RANGES_PER_PARTITION = 4


def _below(scale: int) -> Column:
    return F.lit(-(1 << 63) + (1 << 64) // scale).cast("long")


def sketch(text: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """struct(whole: hash of all words, kept: ascending distinct shingle hashes, all: whether all are kept, not only those below the threshold)."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")

    def of(h: Column) -> Column:
        n = F.size(h)
        short = F.when(n == 0, F.array().cast("array<long>")).otherwise(F.array(F.xxhash64(h)))
        full = F.transform(F.slice(h, F.lit(1), n - (width - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, width))))
        every = n - (width - 1) <= ALL
        kept = F.filter(F.when(n < width, short).otherwise(full), lambda x: every | (x < _below(scale)))
        return F.struct(F.xxhash64(h).alias("whole"), F.array_sort(F.array_distinct(kept)).alias("kept"), every.alias("all"))

    # The one-element array gives the word hashes a name, so that they are computed once.
    return F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), of), F.lit(0))


def to_text(s: Column) -> Column:
    return F.concat(F.hex(s["whole"]), F.lit(":"), F.concat_ws(".", F.transform(s["kept"], lambda x: F.hex(x))))


def _common(a: Column, b: Column, scale: int) -> tuple[Column, Column]:
    """The kept hashes of both that compare: those below the threshold unless both sketches have all."""
    return tuple(F.when(x["all"] & ~y["all"], F.filter(x["kept"], lambda h: h < _below(scale))).otherwise(x["kept"]) for x, y in ((a, b), (b, a)))


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Jaccard estimate of two sketches, 0 to 1."""
    x, y = _common(a, b, scale)
    both = F.size(F.array_intersect(x, y))
    either = F.size(x) + F.size(y) - both
    return F.when(a["whole"] == b["whole"], 1.0).when(either == 0, 0.0).otherwise(both / either)


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of a's shingles that b has; null when a has none to compare."""
    x, y = _common(a, b, scale)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x))


def merge(kept: Column, scale: int = SCALE) -> Column:
    """Union of an array of sketches' kept hashes below the threshold: the sketch of all their texts together."""
    return F.array_sort(F.array_distinct(F.filter(F.flatten(kept), lambda x: x < _below(scale))))


def _literal(values: list, kind: str) -> Column:
    """An array of constants as one literal, however long."""
    return F.from_json(F.lit(json.dumps(values, default=str)), F.lit(f"array<{kind}>"))


def _range_of(value: Column, bounds: list, kind: str) -> Column:
    """How many bounds lie below value, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    powers = [1 << i for i in reversed(range(max(1, len(bounds).bit_length())))]
    q = _literal(bounds, kind)
    return F.aggregate(F.lit(powers), F.lit(0), lambda at, p: F.when(F.get(q, at + p - 1) < value, at + p).otherwise(at))


def with_next(df: DataFrame, key: str, carried: list[str], tie: str, ranges: int | None = None) -> DataFrame:
    """df with ``next``: a struct of the carried columns of the next row by descending key, after the last the first.

    Keys are cut into ranges at approximate quantiles; each range is one window group, and the first rows of a range are
    also sent to the range before it, so that no group is larger than a range and rows move once.  The driver sees one row
    for each range, a number set by the session's shuffle partitions.
    """
    spark = df.sparkSession
    n = ranges or RANGES_PER_PARTITION * shuffle_partitions(spark)
    kind = df.schema[key].dataType.simpleString()
    if not isinstance(df.schema[key].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{key} is {kind}; the order of documents needs a number, a date or a timestamp")
    found = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n)).alias("q")).first().q
    bounds = sorted(set(found or []))
    at = _range_of(F.col(key), bounds, kind)
    heads = sorted(((r["at"], r["head"]) for r in df.groupBy(at.alias("at")).agg(F.max(key).alias("head")).collect()), reverse=True)
    head, before = [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for i, (a, h) in enumerate(heads):
        head[a], before[a] = h, heads[i - 1][0]
    rows = df.withColumn("__at", at)
    again = F.when(F.col(key).eqNullSafe(F.get(_literal(head, kind), F.col("__at"))), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = rows.withColumn("__again", F.explode(again))
    rows = rows.withColumn("__at", F.when(F.col("__again"), F.get(_literal(before, "int"), F.col("__at"))).otherwise(F.col("__at")))
    w = Window.partitionBy("__at").orderBy("__again", F.col(key).desc_nulls_last(), tie)
    return rows.withColumn("next", F.lead(F.struct(*carried)).over(w)).where(~F.col("__again")).drop("__at", "__again")


def fingerprint_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness.

    The edited text: the last half (floor) of the code points replaced by as many of the first of the next document by
    descending key.  Rows with equal keys are in the order of their texts.
    """
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("sk", sketch(F.col("text"), width, scale))
    rows = with_next(own, "key", ["text", "sk"], "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("key", n.cast("long").alias("n_chars"), edited.alias("edited"), "sk", F.col("next.sk").alias("nk"))
    rows = rows.withColumn("ek", sketch(F.col("edited"), width, scale))
    sk, ek, nk = F.col("sk"), F.col("ek"), F.col("nk")
    return rows.select(
        F.col("key").alias(key),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        to_text(sk).alias("fingerprint"),
        to_text(ek).alias("edited_fingerprint"),
        likeness(sk, ek, scale).alias("near_edited"),
        likeness(sk, nk, scale).alias("near_next"),
        containment(sk, ek, scale).alias("contained_edited"),
    )


