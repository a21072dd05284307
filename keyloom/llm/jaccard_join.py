"""N-gram Jaccard self-join by grouped prefixes.

A document's set holds its distinct word shingles (64-bit hashes).  With an overlap of at least ``percent`` of the union,
two documents share one of the first ``n - ceil(percent * n / 100) + 1`` shingles of either, in any fixed order: the
prefix.  The order is by document frequency, so prefixes hold the rarest shingles.

1. Documents with equal sets become one class.
2. Classes that own enough shingles alone (counted over all documents, on the shingles of a fixed part of the hash range) can
   have no partner and leave.  Frequencies are then counted over all shingles of the rest.
3. Documents with the same prefix and size are a group, collapsed to its smallest member: every other member is verified
   against that one, a star.  Then the members that stand for the components of a long list are verified against the list's
   smallest member.  Groups of near copies are mostly one component after that, at a cost in proportion to their size.
4. Prefix shingles become lists; those whose documents are all of one component are done.  In a list, pairs of groups are
   filtered by size and by the shingle's position in the prefix; the groups of the pairs left are expanded to members of
   different components, whose bitmaps bound the overlap from above.  Lists of more than ``BLOCK`` documents are cut into
   units, large components into units of their own, and every pair of units of different components is a task's work of its own.
5. First each list gives a spanning forest of its candidate pairs; they are verified on the whole sets.  Then all candidate
   pairs that are still in different components are verified.  Every link joins documents that end in one component, and no
   large group of copies is expanded into all its pairs.

Null and empty texts and texts without a word have an empty set and link with nothing.  A text with fewer words than a
shingle is one shingle.  Rows with equal id and text count as one document; rows with one id and different texts share a
component, but for those without a word; rows with a null id link nothing.  Empty tables give empty results.  Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash
from .common import materialize, shuffle_partitions
from .components import components

WIDTH, PERCENT = 5, 80
#: 64-bit words of the bitmap that bounds the overlap of two sets.
BITMAP = 8
#: Members of a list that are compared at once.
BLOCK = 1024
#: Lists of more components than this get a star of their own.
STAR_COMPONENTS = 32
#: Rows of classes (an id, a node and two signatures; some 50 bytes) that are broadcast to pick documents at most; more are joined by shuffle.
BROADCAST_IDS = 200_000
#: Pairs of one document that meet its set in one task.
PAIRS_PER_SALT = 1024


def _range_share(percent: int) -> float:
    """Part of the hash range on which classes are shown to have no partner; any value is right."""
    return min(1.0, 2.2 * (100 - percent) / 100 + 0.1)


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of each text, and where each text's begin."""
    _, _, _, h, first = wordhash.words(texts)
    return wordhash.distinct_per_text(*wordhash.shingles(h, first, width), len(texts))


def _signatures(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of differently mixed hashes for each set."""
    out = []
    for salt in (0x1234567, 0x89ABCDEF):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(wordhash.mix(hashes ^ np.uint64(salt)), dtype=np.uint64)))
        out.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _outline(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """id, n, s1, s2 (the set's signature) and low: 32 bits of each hash below a fixed part of the range."""
    top = np.uint64(min(2**64 - 1, int(_range_share(percent) * 2**64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in wordhash.steps(b.column(1)):
                hashes, first = _sets(part, width)
                s1, s2 = _signatures(hashes, first)
                low = hashes <= top
                begin = np.concatenate(([0], np.cumsum(low)))[first]
                tokens = (hashes[low] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                yield pa.record_batch(
                    [b.column(0).slice(at, len(part)), pa.array(np.diff(first).astype(np.int32)), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(tokens))],
                    names=["id", "n", "s1", "s2", "low"],
                )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n int, s1 long, s2 long, low array<int>")


def _whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """id, n, s1, s2, set (all hashes, ascending) and bits of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in wordhash.steps(b.column(1)):
                hashes, first = _sets(part, width)
                s1, s2 = _signatures(hashes, first)
                sets = [hashes[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
                # Each hash flips one bit, so the bits in which two bitmaps differ are at most the hashes not shared.
                which = (wordhash.mix(hashes) % np.uint64(64 * BITMAP)).astype(np.int64)
                owner = np.repeat(np.arange(len(part)), np.diff(first))
                odd = np.bincount(owner * 64 * BITMAP + which, minlength=len(part) * 64 * BITMAP).astype(np.uint8) & 1
                bits = np.packbits(odd.reshape(len(part), -1), axis=1, bitorder="little")
                yield pa.record_batch(
                    [b.column(0).slice(at, len(part)), pa.array(np.diff(first).astype(np.int32)), pa.array(s1), pa.array(s2), pa.array(sets, pa.binary()), pa.array([r.tobytes() for r in bits], pa.binary())],
                    names=["id", "n", "s1", "s2", "set", "bits"],
                )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n int, s1 long, s2 long, set binary, bits binary")


def _tokens(sets: DataFrame) -> DataFrame:
    """id, cid, n, t: a row for each hash of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(3).to_pylist()
            t = np.frombuffer(b"".join(blobs), dtype=np.int64)
            begin = np.concatenate(([0], np.cumsum([len(x) // 8 for x in blobs]))).astype(np.int32)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(pa.array(begin), pa.array(t))], names=["id", "cid", "n", "t"])

    kind, named = sets.schema["id"].dataType.simpleString(), sets.schema["cid"].dataType.simpleString()
    return sets.select("id", "cid", "n", "set").mapInArrow(run, f"id {kind}, cid {named}, n int, t array<long>").select("id", "cid", "n", F.explode("t").alias("t"))


def least_overlap(n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection with which sets of these sizes link: 100 i >= percent (n1 + n2 - i)."""
    return -(-percent * (n1 + n2) // (100 + percent))


def list_pairs(n, pos, gid, bits, comp, block, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (i, j) of one list: groups are filtered first, then the members of the groups left."""
    _, lead, group = np.unique(gid, return_index=True, return_inverse=True)
    gn, room = n[lead], (n - pos)[lead]
    need = least_overlap(gn[:, None], gn[None], percent)
    ok = (np.minimum(room[:, None], room[None]) >= need) & (np.minimum(gn[:, None], gn[None]) >= need)
    if not ok.any():
        return np.zeros(0, int), np.zeros(0, int)
    pairs = ok[group][:, group]
    pairs &= comp[:, None] != comp[None]
    pairs &= np.triu(np.ones_like(pairs), 1) if block is None else block[:, None] < block[None]
    i, j = np.nonzero(pairs)
    keep = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 1 << 17):
        a, b = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
        differ = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
        keep[at : at + (1 << 17)] = (n[a] + n[b] - differ) // 2 >= least_overlap(n[a], n[b], percent)
    return i[keep], j[keep]


def forest(i: np.ndarray, j: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph with edges (i, j) on m nodes, grown breadth first from the smallest nodes."""
    if len(i) <= 1:
        return i, j
    order = np.argsort(np.concatenate((i, j)), kind="stable")
    to = np.concatenate((j, i))[order]
    begin = np.searchsorted(np.concatenate((i, j))[order], np.arange(m + 1))
    seen, a, b = np.zeros(m, dtype=bool), [], []
    for root in np.unique(np.concatenate((i, j))):
        if seen[root]:
            continue
        seen[root], queue = True, [int(root)]
        for v in queue:
            new = np.unique(to[begin[v] : begin[v + 1]])
            new = new[~seen[new]]
            seen[new] = True
            a += [v] * len(new)
            b += new.tolist()
            queue += new.tolist()
    return np.array(a, dtype=int), np.array(b, dtype=int)


def _candidates(lists: DataFrame, percent: int, spanning: bool) -> DataFrame:
    """(a, b): candidate pairs of all lists, or a spanning forest of each list's."""
    kind = lists.schema["id"].dataType.simpleString()

    def of_list(rows: pa.Table) -> tuple[pa.Array, pa.Array] | None:
        if rows.num_rows < 2:
            return None
        col = lambda name: rows.column(name).to_numpy()
        order = np.argsort(col("id"), kind="stable")
        rows = rows.take(pa.array(order))
        n, pos = col("n").astype(np.int64), col("pos").astype(np.int64)
        bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), dtype=np.uint64).reshape(-1, BITMAP)
        block = None if rows.column("bi")[0] == rows.column("bj")[0] else (col("block") == rows.column("bj")[0].as_py()).astype(int)
        i, j = list_pairs(n, pos, col("gid"), bits, col("comp"), block, percent)
        if spanning:
            i, j = forest(i, j, rows.num_rows)
        ids = rows.column("id").combine_chunks()
        return (ids.take(pa.array(i)), ids.take(pa.array(j))) if len(i) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            keys = np.column_stack([t.column(c).to_numpy() for c in ("t", "bi", "bj")])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            edges = [0, *cuts.tolist()]
            found = [f for x, y in zip(edges[:-1], edges[1:], strict=True) if (f := of_list(t.slice(x, y - x)))]
            held = t.slice(edges[-1])
            if found:
                yield pa.record_batch([pa.concat_arrays([f[0] for f in found]), pa.concat_arrays([f[1] for f in found])], names=["a", "b"])
        if held is not None and (f := of_list(held)):
            yield pa.record_batch([f[0], f[1]], names=["a", "b"])

    placed = lists.repartition(shuffle_partitions(lists.sparkSession), "t", "bi", "bj").sortWithinPartitions("t", "bi", "bj")
    found = placed.mapInArrow(run, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): smallest keys of the classes whose sets really link."""

    @F.pandas_udf("long")
    def overlap(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x), dtype=np.int64)
        for i, (p, q) in enumerate(zip(x, y, strict=True)):
            p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
            p, q = (p, q) if len(p) <= len(q) else (q, p)
            out[i] = (q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()
        return pd.Series(out)

    pairs = materialize(pairs, "jaccard-pairs")
    both = _attach(_attach(pairs, sets, "a", "b"), sets, "b", "a").select("ca", "cb", "na", "nb", overlap("sa", "sb").alias("i"))
    return both.where((100 + percent) * F.col("i") >= percent * (F.col("na") + F.col("nb"))).select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def _attach(pairs: DataFrame, sets: DataFrame, side: str, other: str) -> DataFrame:
    """pairs with the class, size and set of one side.  The set of a document with many pairs goes to several tasks."""
    own = sets.select(F.col("id").alias(side), F.col("cid").alias(f"c{side}"), F.col("n").alias(f"n{side}"), F.col("set").alias(f"s{side}"))
    many = pairs.groupBy(side).agg(F.ceil(F.count("*") / PAIRS_PER_SALT).cast("int").alias("salts")).where("salts > 1")
    if many.isEmpty():
        return pairs.join(own, side)
    salts = F.coalesce("salts", F.lit(1))
    pairs = pairs.join(many, side, "left").withColumn("salt", F.pmod(F.xxhash64(other), salts).cast("int")).drop("salts")
    own = own.join(many, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return pairs.join(own, [side, "salt"]).drop("salt")


def _with_components(entries: DataFrame, comps: DataFrame | None) -> DataFrame:
    """entries with comp: a hash of the component of each, so far its class if it is in none."""
    if comps is None:
        return entries.withColumn("comp", F.xxhash64("cid"))
    return entries.join(comps.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.xxhash64(F.coalesce("component", "cid"))).drop("component")


def _list_stars(entries: DataFrame, comps: DataFrame | None) -> DataFrame:
    """(a, b): in long lists, the list's smallest document with the smallest one of each other component."""
    per = _with_components(entries, comps).groupBy("t", "comp").agg(F.min("id").alias("b"))
    pivots = per.groupBy("t").agg(F.min("b").alias("a"), F.count("*").alias("k")).where(F.col("k") > STAR_COMPONENTS).drop("k")
    return per.join(pivots, "t").where("a != b").select("a", "b").distinct()


def _lists(entries: DataFrame, sets: DataFrame, comps: DataFrame | None) -> DataFrame:
    """t, bi, bj, block, id, cid, n, pos, gid, comp, bits: the documents of each pair of units of each list that has several components."""
    known = _with_components(entries, comps)
    per = known.groupBy("t", "comp").agg(F.count("*").alias("c"))
    lists = materialize(per.groupBy("t").agg(F.sum("c").alias("size"), F.count("*").alias("k")).where("k > 1").select("t", "size"), "jaccard-lists")
    zero = F.lit(0)
    placed = known.join(lists.where(F.col("size") <= BLOCK).select("t"), "t").withColumns({"bi": zero, "bj": zero, "block": zero})
    long = lists.where(F.col("size") > BLOCK)
    if not long.isEmpty():
        # Large components have units of their own, the others share units; a row for each unit of long lists only.
        of = per.join(long.select("t"), "t").withColumn("large", F.col("c") > BLOCK // 2)
        k = F.ceil(F.col("c") / BLOCK).cast("int")
        shared = of.where("not large").groupBy("t").agg(F.sum("c").alias("c")).select("t", F.lit(None).cast("long").alias("comp"), k.alias("units"))
        units = of.where("large").select("t", "comp", k.alias("units")).unionByName(shared)
        before = Window.partitionBy("t").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1)
        units = materialize(units.withColumn("start", F.coalesce(F.sum("units").over(before), zero).cast("int")), "jaccard-units")
        each = units.select("t", "comp", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("units") - 1)).alias("block"))
        x, y = each.select("t", F.col("comp").alias("x"), F.col("block").alias("bi")), each.select("t", F.col("comp").alias("y"), F.col("block").alias("bj"))
        pairs = x.join(y, "t").where("bi < bj and (x is null or y is null or x != y) or bi = bj and x is null")
        pairs = pairs.withColumn("block", F.explode(F.array_distinct(F.array("bi", "bj")))).select("t", "bi", "bj", "block")
        own = units.where("comp is not null").withColumnsRenamed({"units": "u1", "start": "s1"})
        rest = units.where("comp is null").select("t", F.col("units").alias("u2"), F.col("start").alias("s2"))
        at = known.join(long.select("t"), "t").join(own, ["t", "comp"], "left").join(rest, "t", "left")
        block = F.coalesce("s1", "s2") + F.pmod(F.xxhash64("id"), F.coalesce("u1", "u2")).cast("int")
        at = at.withColumn("block", block).join(pairs, ["t", "block"])
        placed = placed.unionByName(at.select(*placed.columns))
    return placed.join(sets.select("id", "bits"), "id").select("t", "bi", "bj", "block", "id", "cid", "n", "pos", "gid", "comp", "bits")


def _prefix_size(n: Column, percent: int) -> Column:
    return n - F.ceil(F.lit(percent) * n / 100).cast("int") + 1


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable by links) of every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    outline = materialize(_outline(texts, width, percent), "jaccard-outline")
    meta = outline.select("id", "n", "s1", "s2")
    full = outline.where("n > 0")

    # Shingles of one class only, and the classes with enough of them.
    seen = full.select("s1", "n", F.explode("low").alias("t")).groupBy("t").agg(F.min("s1").alias("s1"), F.max("s1").alias("x"), F.max("n").alias("n"))
    alone = seen.where("s1 = x").groupBy("s1").agg(F.count("*").alias("u"), F.max("n").alias("n"))
    alone = alone.where(F.col("u") >= _prefix_size(F.col("n"), percent)).select("s1")

    classes = materialize(meta.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("cid")).where("cid is not null").join(alone, "s1", "left_anti"), "jaccard-classes")
    # Ids of rows with different texts.  Where there are any, an id may stand for several classes: these go by a hash then.
    kinds = meta.where("n > 0 and id is not null").groupBy("id").agg(F.min(F.xxhash64("s1", "s2", "n")).alias("x"), F.max(F.xxhash64("s1", "s2", "n")).alias("y"))
    again = materialize(kinds.where("x != y").select("id"), "jaccard-again")
    has_again = not again.isEmpty()
    node = F.xxhash64("s1", "s2", "n") if has_again else F.col("cid")
    wanted = classes.select(F.col("cid").alias("id"), F.col("s1").alias("w1"), F.col("s2").alias("w2"), node.alias("node"))
    n_classes = classes.count()
    if n_classes <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = _whole_sets(texts.join(wanted.select("id"), "id", "left_semi"), width)
    sets = sets.join(wanted, "id").where("s1 = w1 and s2 = w2").select(F.col("node").alias("id"), F.col("id").alias("cid"), "n", "set", "bits")
    sets = materialize(sets, "jaccard-sets")
    if sets.count() > n_classes:  # repeated rows
        sets = materialize(sets.dropDuplicates(["id"]), "jaccard-sets")

    # Prefixes by document frequency; what a class owns alone comes first and matches nothing.
    tokens = _tokens(sets)
    shared = tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    owned = tokens.join(shared, "t").groupBy("id").agg(F.max("n").alias("n"), F.max("cid").alias("cid"), F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts"))
    lonely = F.col("n") - F.size("ts")
    prefixed = owned.select("id", "cid", "n", lonely.alias("u"), F.slice(F.col("ts.t"), F.lit(1), F.greatest(F.lit(0), _prefix_size(F.col("n"), percent) - lonely)).alias("p"))
    prefixed = prefixed.where(F.size("p") > 0).withColumn("gid", F.xxhash64("n", "u", "p"))
    entries = prefixed.select("id", "cid", "n", "u", "gid", F.posexplode("p").alias("i", "t")).select("id", "cid", "n", "gid", "i", (F.col("u") + F.col("i")).alias("pos"), "t")
    entries = materialize(entries, "jaccard-prefixes")

    # Each group's star, then the stars of long lists.
    members = entries.where("i = 0").select("id", "gid")
    groups = members.groupBy("gid").agg(F.min("id").alias("a"), F.count("*").alias("k")).where("k > 1").drop("k")
    stars = members.withColumnRenamed("id", "b").join(groups, "gid").where("a != b").select("a", "b")
    comps = components(materialize(_verify(stars, sets, percent), "jaccard-links"), "jaccard-stars")
    grow = lambda links, tag: components(comps.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(materialize(links, "jaccard-links")), tag)
    comps = grow(_verify(_list_stars(entries, comps), sets, percent), "jaccard-stars")

    comps = grow(_verify(_candidates(_lists(entries, sets, comps), percent, True), sets, percent), "jaccard-first")
    more = materialize(_verify(_candidates(_lists(entries, sets, comps), percent, False), sets, percent), "jaccard-more")
    edges = comps.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)

    # Every document has the component of its class; classes without links are components of their own.
    all_classes = meta.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("cid"))
    if has_again:  # the classes of one id belong together
        told = meta.join(again, "id", "left_semi").join(all_classes, ["s1", "s2", "n"])
        edges = edges.unionByName(told.select(F.col("id").alias("a"), F.col("cid").alias("b")).distinct())
    final = components(edges, "jaccard-final")
    placed = all_classes.join(final.withColumnRenamed("id", "cid"), "cid", "left").select("s1", "s2", "n", F.coalesce("component", "cid").alias("component"))
    out = meta.join(placed, ["s1", "s2", "n"], "left")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))
