"""Mixing sources to target token counts.

Every document gets a hash-random key.  Within its source the keys are range-partitioned into buckets, token counts are
summed per bucket, and the buckets' running totals plus a running sum inside each bucket give every document its exact
place in the source's order.  A source's budget is filled with whole epochs and then cut at the exact token: the document
at the cut gives only its first tokens.  No source is sorted in one task, so a source with most of the rows is no
bottleneck; only (key, source, size) are shuffled, never texts.

Targets: sources in code-point order, null last, get the weights in turn and share the tokens of all sources by weight;
no target exceeds ``max_epochs`` times the source's tokens, and what that frees is shared again by weight.

Null text: size 0.  Null source: a source of its own.  Null keys are ordered last.  Rows with the same key are ordered by
the text's hash; rows equal in both are interchangeable, so any order gives the same rows.  Empty tables give empty
results.  Only the key, text and source columns are read; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

#: A source of n documents has about sqrt(n) buckets of sqrt(n) documents: neither they nor their totals pile up in a task.
#: Source tables up to so many bytes are broadcast; larger ones are joined by shuffle, in which Spark splits a source of many rows.
BROADCAST_BYTES = 16 << 20


def token_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and 0x09-0x0D; 0 for null."""
    sep = r"[\x20\x09-\x0D]"
    pieces = F.size(F.split(text, sep + "+")) - text.rlike(f"^{sep}").cast("int") - text.rlike(sep + r"\z").cast("int")
    return F.when(text.isNull() | (F.length(text) == 0), 0).otherwise(pieces).cast("long")


def _running(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column], tag: str) -> tuple[DataFrame, dict]:
    """rows, written in a total order, with for each name the sum of its column over all rows before; and the sums over all rows.

    Rows are dealt out by range and sorted within their range; only a total for each range comes to the driver.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt, tag).withColumn("_range", F.shiftright("_at", 33))
    total = [F.sum(c).alias(name) for name, c in sums.items()]
    ranges = dealt.groupBy("_range").agg(*total)
    kinds = {n: ranges.schema[n].dataType.simpleString() for n in sums}
    starts, now = [], {n: 0.0 if kinds[n] == "double" else 0 for n in sums}
    for r in sorted(ranges.collect(), key=lambda r: r._range):
        starts.append((r._range, *now.values()))
        now = {n: x + r[n] for n, x in now.items()}
    table = spark.createDataFrame(starts, ", ".join(["_range long", *[f"_{n} {kinds[n]}" for n in sums]]))
    before = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(table), "_range").withColumns({n: F.col(f"_{n}") + F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()})
    return out.drop("_range", "_at", *[f"_{n}" for n in sums]), now


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """sizes (src, source_size, n) with sid, the source's place among all, and target.

    Sources reach their cap in the order of cap per weight, so one total order of them tells at which level of tokens per weight the
    others stop.  Only that level and totals come to the driver, whatever the number of sources.
    """
    cap = F.col("source_size") * max_epochs
    ranked, size = _running(sizes, [F.asc_nulls_last("src")], {"sid": F.lit(1), "before": F.col("source_size")}, "mix-sources")
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    filled, total = _running(ranked.withColumn("ratio", cap / F.col("w")), [F.col("ratio"), F.col("sid")], {"capped": cap, "used": F.col("w")}, "mix-levels")
    level = (F.lit(size["before"]) - F.col("capped")) / (F.lit(total["used"]) - F.col("used"))
    stop = filled.where(F.col("w") * level <= cap).agg(F.min(F.struct("ratio", "sid", level.alias("level"))).alias("s")).first().s
    target = cap.cast("double")
    if stop is not None:
        below = (F.col("ratio") < stop.ratio) | (F.col("ratio") == stop.ratio) & (F.col("sid") < stop.sid)
        target = F.when(below, target).otherwise(F.least(F.col("w") * stop.level, target))
    return filled.select("sid", "src", "source_size", "n", target.alias("target"))


def _hash_key(key: Column, seed: str) -> Column:
    """60 bits of md5, so that any SQL engine can compute the same order."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix-1:"
) -> DataFrame:
    """key, source, size, source_size, target, taken (tokens that the mix takes), epochs (whole copies), cut (tokens of one more)."""
    t, k = F.col(text), F.col(key)
    sized = materialize(docs.select(k.alias("k"), F.col(source).alias("src"), token_count(t).alias("size"), _hash_key(k, seed).alias("h"), F.xxhash64(t).alias("th")), "mix-sizes")
    per = materialize(sized.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-totals")
    table = targets(per, weights, max_epochs).select("sid", F.col("src").alias("src2"), "source_size", "target", (F.floor(F.sqrt("n")) + 1).alias("buckets"))
    # 64 bytes and the name for each source.
    if (per.agg(F.sum(F.coalesce(F.octet_length("src"), F.lit(0)) + 64).alias("b")).first().b or 0) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    rows = sized.join(table, F.col("src").eqNullSafe(F.col("src2"))).drop("src2")
    rows = rows.withColumn("bucket", F.least(F.floor(F.col("h") / F.lit(float(1 << 60)) * F.col("buckets")), F.col("buckets") - 1))
    # What lies before each bucket of a source: a row for each bucket only.
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("s")).select("sid", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", F.col("k").asc_nulls_last(), "th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("run", F.sum("size").over(inside)).join(starts, ["sid", "bucket"])
    budget = F.floor(F.col("target") + 0.5)
    placed = placed.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    left = budget - F.col("epochs") * F.col("source_size") - (F.col("offset") + F.col("run") - F.col("size"))
    placed = placed.withColumn("cut", F.greatest(F.lit(0), F.least(left, F.col("size"))).cast("long"))
    return placed.select(
        F.col("k").alias(key), F.col("src").alias(source), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"), "epochs", "cut", F.col("th").alias("text_hash")
    )


def mixed_copies(docs: DataFrame, mix: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them, with their own columns; the copy at a source's cut ends after its last token.

    ``mix`` is mix_sources() of the same docs.  Rows equal in key, text and source stand side by side in the mix, so at most one
    set of them in each source has the cut inside: only its rows are numbered, all others are taken alike.
    """
    k, h, s, e, c, n, rows_, full, one, at, copy = (fresh(docs, f"mix_{x}") for x in ("k", "h", "s", "e", "c", "n", "rows", "full", "one", "at", "copy"))
    cut, size = F.col("cut"), F.col("size")
    part = mix.groupBy(F.col(key).alias(k), F.col("text_hash").alias(h), F.col(source).alias(s)).agg(
        F.max("epochs").alias(e), F.min("cut").alias(c), F.max("size").alias(n), F.count("*").alias(rows_), F.sum((cut == size).cast("long")).alias(full), F.max(F.when(cut < size, cut).otherwise(0)).alias(one)
    )
    part = part.where((F.col(e) > 0) | (F.col(full) > 0) | (F.col(one) > 0)).where(F.col(n) > 0)
    same = F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(h)) & F.col(source).eqNullSafe(F.col(s))
    alike = (F.col(full) == F.col(rows_)) | (F.col(full) == 0) & ((F.col(rows_) == 1) | (F.col(one) == 0))
    order = Window.partitionBy(k, h, s).orderBy(F.xxhash64(*docs.columns))
    numbered = docs.join(part.where(~alike), same).withColumn(at, F.row_number().over(order).cast("long"))
    # The first rows have whole cuts, the next one the rest of the budget.
    own = F.when(F.col(at) <= F.col(full), F.col(n)).when(F.col(at) == F.col(full) + 1, F.col(one)).otherwise(0)
    rows = docs.join(part.where(alike), same).withColumn(at, F.lit(None).cast("long")).unionByName(numbered.withColumn(c, own))
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(e) + (F.col(c) > 0).cast("long"))))
    # Pieces of one token each, with the separators before it.
    pieces = F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    last = (F.col(copy) > F.col(e)) & (F.col(c) < F.col(n))
    rows = rows.where((F.col(e) > 0) | (F.col(c) > 0)).withColumn(text, F.when(last, F.concat_ws("", F.slice(pieces, F.lit(1), F.col(c).cast("int")))).otherwise(F.col(text)))
    return rows.select(*docs.columns)
