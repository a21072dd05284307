"""Language-model scoring with Brown classes.

All training words are clustered by the exchange algorithm: a word moves to the class that raises the likelihood of the class
bigrams most.  It starts on the driver with the ``FREQUENT`` top words, one after the other until none moves, while every
other word is in a class of words about as frequent (powers of two).  Then rounds over all words follow, in which each word has
all classes to choose from and sees the others where they were before the round.  In the first, all words that have only a
frequency class so far take a class; in the others half of all words may move, fewer when so many at once don't raise the
likelihood.  Rounds end when one adds less than ``TOLERANCE`` of the likelihood, or after ``rounds``, a parameter whose default
``ROUNDS`` holds the cost; that many are enough for every word to have chosen, not for none to move any more.  Unseen words have
a class of their own, which stands where words seen once do, and the end of a text is a class.  A token's probability is that of
its class after the class before it (smoothed by the class's own frequency) times that of the word in its class.

How it is gathered: texts are read once, into chunks of word numbers (see ``chunks``).  Chunks and the words of each hash range
stay where they were dealt to.  A round sends each chunk a byte for each of its words, the class, and each word's neighbours'
classes back, two bytes or so for each distinct pair of a chunk; neither texts nor tokens are shuffled again.  The driver only
sees the ``FREQUENT`` top words, the bigrams of these and the frequency classes, and the bigrams of classes.

Null and empty texts are one end token.  Texts are scored whole.  Rows with one id are scored apart.  Empty tables give
empty results.  Only id and text are read, so other columns cannot clash.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import gc
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks, wordhash
from .common import materialize

FREQUENT, CLASSES = 1000, 48
#: Rounds over all words at most.
ROUNDS = 5
#: Weight of a class's own frequency against what follows the class before it.
PRIOR = 20.0
_LEVELS = 63
#: Finer levels of counts for each power of two, to find the frequent words.
_FINE = 4
#: Items of a bigram: the frequent words, the end of a text, and a class for each power of two.
_END, _RARE = FREQUENT, FREQUENT + 1
_ITEMS = FREQUENT + 1 + _LEVELS
#: Classes: the clustered ones, the end of a text, the frequency classes of the start, and unseen words.
_END_CLASS, _UNSEEN = CLASSES, CLASSES + 1 + _LEVELS
_ALL = _UNSEEN + 1
#: Marks words seen once where a class is sent.
_ONCE = 128
#: Clustering ends when a round adds less than this share of the likelihood, or when so small a share of the words, moving at once, doesn't raise it.
TOLERANCE, LEAST_SHARE = 1e-3, 1 / 64
#: Words whose moves are found in one vectorised step, and counts for which gains are looked up.
_STEP_WORDS, _SMALL = 1024, 32
#: Slots of a word's neighbours: classes behind it, classes before it, and the word itself.
_SLOTS = 2 * _ALL + 1
_STATE = "place long, bucket int, a binary, b binary"
_AROUND = "place long, bucket int, chunk long, a binary, b binary, c binary"


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, _, _, h, first = wordhash.words(texts)
    return h, np.diff(first)


def _number(steps: list[np.ndarray], flags: np.ndarray, buckets: int) -> tuple[np.ndarray, list[int], Callable]:
    """The distinct words of a chunk in the order of hashes, with their counts in training texts."""
    codes, words = pd.factorize(np.concatenate(steps))
    order = np.argsort(words)
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    words, numbers = words[order], rank[codes]
    counts = np.bincount(numbers[flags > 0], minlength=len(words))

    def blobs(i: int, j: int) -> tuple[bytes, bytes]:
        return chunks.pack(np.diff(words[i:j], prepend=np.uint64(0)), "<u8"), chunks.pack(counts[i:j])

    return numbers, chunks.bucket_edges(words, buckets), blobs


class _Bucket:
    """The words of one hash range, as chunks have them."""

    def __init__(self, rows: pa.Table):
        self.chunks = [chunks.chunk_of(c) for c in rows["c"].to_pylist()]
        self.hashes = [np.cumsum(chunks.unpack(a, "<u8"), dtype=np.uint64) for a in rows["a"].to_pylist()]
        self.words = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.hashes]))
        self.at = {c: np.searchsorted(self.words, h) for c, h in zip(self.chunks, self.hashes, strict=True)}


def _count(words: DataFrame) -> DataFrame:
    """Training counts of the words of each bucket, how many words and tokens that makes, the most frequent ones, and how many words there are of each level."""

    def run(rows: pa.Table) -> pa.Table:
        b = _Bucket(rows)
        counts = np.bincount(np.concatenate([b.at[c] for c in b.chunks]), np.concatenate([chunks.unpack(x) for x in rows["b"].to_pylist()]), len(b.words)).astype(np.int64)
        h = b.words.view(np.int64)
        top = np.lexsort((h, -counts))[:FREQUENT]
        top = top[counts[top] > 0]
        best = [{"h": int(h[i]), "n": int(counts[i])} for i in top]
        row = {"place": rows["place"][0].as_py(), "bucket": rows["bucket"][0].as_py(), "a": chunks.pack(counts, "<i8"), "v": int((counts > 0).sum()), "n": int(counts.sum()), "top": best, "levels": np.bincount(_level(counts[counts > 0]), minlength=_FINE * _LEVELS).tolist()}
        return pa.Table.from_pylist([row], schema=pa.schema([("place", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("v", pa.int64()), ("n", pa.int64()), ("top", pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))), ("levels", pa.list_(pa.int64()))]))

    return words.groupBy("place").applyInArrow(run, "place long, bucket int, a binary, v long, n long, top array<struct<h:long,n:long>>, levels array<long>")


def _level(counts: np.ndarray) -> np.ndarray:
    """Counts by their logarithm, in steps of 1 / _FINE of a power of two."""
    return (np.log2(counts.astype(float)) * _FINE).astype(np.int64)


def _frequent(counted: DataFrame) -> list[int]:
    """Hashes of the FREQUENT top words, by rank.  Only words of the levels that they come from are sorted."""
    sums = counted.agg(*[F.sum(F.get("levels", F.lit(i))).alias(f"n{i}") for i in range(_FINE * _LEVELS)]).first()
    above = np.cumsum([n or 0 for n in sums][::-1])[::-1]
    least = max(np.flatnonzero(above >= min(FREQUENT, above[0])).max(initial=0), 0)
    low = 2 ** (float(least) / _FINE) * (1 - 1e-9)
    top = counted.select(F.explode(F.filter("top", lambda x: x["n"] >= low)).alias("t")).select("t.*")
    return [r.h for r in top.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()]


def _state(place: int, bucket: int, counts: bytes, codes: np.ndarray, kind: str) -> pa.Table:
    return pa.table([pa.array([place]), pa.array([bucket], pa.int32()), pa.array([counts], pa.binary()), pa.array([chunks.pack(codes, kind)], pa.binary())], names=["place", "bucket", "a", "b"])


def _items(words: DataFrame, counted: DataFrame, top: list[int]) -> DataFrame:
    """Counts and items of the words of each bucket; ``top`` has the hashes of the frequent words by rank."""
    hashes = np.array(top, dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        b = _Bucket(rows)
        counts = chunks.unpack(known["a"][0].as_py(), "<i8")
        items = _RARE + np.log2(np.maximum(counts, 1).astype(float)).astype(np.int16)
        at = np.searchsorted(b.words, hashes[order])
        has = (at < len(b.words)) & (b.words[np.minimum(at, len(b.words) - 1)] == hashes[order])
        items[at[has]] = order[has]
        return _state(rows["place"][0].as_py(), rows["bucket"][0].as_py(), known["a"][0].as_py(), items, "<i2")

    return words.groupBy("place").cogroup(counted.select("place", "a").groupBy("place")).applyInArrow(run, _STATE)


def _answers(words: DataFrame, state: DataFrame, kind: str, with_counts: bool = False) -> DataFrame:
    """For each chunk and bucket the codes of the chunk's words (and whether they were seen once), and their counts if asked for."""

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        b = _Bucket(rows)
        counts, codes = chunks.unpack(known["a"][0].as_py(), "<i8"), chunks.unpack(known["b"][0].as_py(), kind)
        if kind == "u1":
            codes = codes | (_ONCE * (counts == 1)).astype(np.uint8)
        sent = [chunks.pack(codes[b.at[c]], kind) for c in b.chunks]
        told = [chunks.pack(counts[b.at[c]], "<i8") if with_counts else None for c in b.chunks]
        n = len(b.chunks)
        return pa.table([pa.array(b.chunks, pa.int64()), pa.array([rows["bucket"][0].as_py()] * n, pa.int32()), pa.array(sent, pa.binary()), pa.array(told, pa.binary())], names=["place", "bucket", "a", "b"])

    return words.groupBy("place").cogroup(state.groupBy("place")).applyInArrow(run, _STATE)


def _sequence(texts: pa.Table, end: int) -> np.ndarray:
    """The word numbers of a chunk's training texts, with an end before, between and after them."""
    parts = [np.array([end])]
    for a, b, c in zip(texts["a"].to_pylist(), texts["b"].to_pylist(), texts["c"].to_pylist(), strict=True):
        sizes, numbers, train = chunks.unpack(a), chunks.unpack(b), chunks.unpack(c, "u1") > 0
        seq = np.full(int(sizes.sum()) + len(sizes), end, dtype=np.int64)
        ends = np.cumsum(sizes + 1) - 1
        word = np.ones(len(seq), dtype=bool)
        word[ends] = False
        seq[word] = numbers
        parts.append(seq[np.repeat(train, sizes + 1)])
    return np.concatenate(parts)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def _codes(answers: pa.Table, column: str, kind: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The codes of a chunk's words by number, and (bucket, words in it)."""
    found = chunks.in_order(answers)
    parts = [chunks.unpack(r[column], kind) for r in found]
    return np.concatenate([np.zeros(0, kind), *parts]), [(r["bucket"], len(p)) for r, p in zip(found, parts, strict=True)]


def _square(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of rows (p, n) as a matrix; at most size squared rows come to the driver."""
    out = np.zeros(size * size)
    found = rows.groupBy("p").agg(F.sum("n").alias("n")).toPandas()
    out[found.p.to_numpy(dtype=np.int64)] = found.n.to_numpy()
    return out.reshape(size, size)


def _bigrams(texts: DataFrame, answers: DataFrame) -> np.ndarray:
    """Counts [before, after] of the items of training texts; a text begins after an end and ends with one."""

    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        codes, _ = _codes(words, "a", "<i2")
        seq = np.append(codes, _END).astype(np.int64)[_sequence(rows, len(codes))]
        p, n = _runs(seq[:-1] * _ITEMS + seq[1:])
        return pa.table({"p": p, "n": n})

    return _square(texts.groupBy("place").cogroup(answers.groupBy("place")).applyInArrow(run, "p long, n long"), _ITEMS)


def _around(texts: DataFrame, answers: DataFrame) -> DataFrame:
    """For each chunk and bucket the neighbours of its words in training texts (how many cells each word has, their slots, their counts); in bucket -1 the chunk's bigrams of classes (places, counts).

    For the class of unseen words, bigrams are those of words seen once.
    """

    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        codes, sizes = _codes(words, "a", "u1")
        chunk = rows["place"][0].as_py() if rows.num_rows else 0
        seq = _sequence(rows, len(codes))
        sent = np.append(codes, _END_CLASS)[seq]
        cls, once = (sent & (_ONCE - 1)).astype(np.int64), sent >= _ONCE
        pairs = cls[:-1] * _ALL + cls[1:]
        total = np.bincount(pairs, minlength=_ALL * _ALL) + np.bincount(_UNSEEN * _ALL + cls[1:][once[:-1]], minlength=_ALL * _ALL) + np.bincount(cls[:-1][once[1:]] * _ALL + _UNSEEN, minlength=_ALL * _ALL)
        at = np.flatnonzero(total)
        out = [(-1 - (chunk >> 24), -1, chunk, chunks.pack(at), chunks.pack(total[at], "<i8"), None)]
        word, twice = seq < len(codes), seq[:-1] == seq[1:]
        after, before = word[:-1], word[1:] & ~twice
        keys, n = _runs(np.concatenate((seq[:-1][after] * _SLOTS + np.where(twice, 2 * _ALL, cls[1:])[after], seq[1:][before] * _SLOTS + _ALL + cls[:-1][before])))
        who, slots = keys // _SLOTS, (keys % _SLOTS).astype(np.uint8)
        cells = np.bincount(who, minlength=len(codes))
        words_at, cells_at = 0, 0
        for bucket, size in sizes:
            own = cells[words_at : words_at + size]
            end = cells_at + int(own.sum())
            if end > cells_at:
                out.append((-1 - bucket, bucket, chunk, chunks.pack(own, "u1"), chunks.pack(slots[cells_at:end], "u1"), chunks.pack(n[cells_at:end])))
            words_at, cells_at = words_at + size, end
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["place", "bucket", "chunk", "a", "b", "c"])

    return texts.groupBy("place").cogroup(answers.groupBy("place")).applyInArrow(run, _AROUND)


def _class_bigrams(around: DataFrame) -> np.ndarray:
    """Counts [before, after] of the classes of training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_ALL * _ALL, dtype=np.int64)
        for b in batches:
            for at, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[chunks.unpack(at)] += chunks.unpack(n, "<i8")
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["p", "n"])

    return _square(around.where("bucket = -1").select("a", "b").mapInArrow(run, "p long, n long"), _ALL)


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def likelihood(n: np.ndarray) -> float:
    """What the classes add to the log likelihood of the words, from the counts of their bigrams."""
    return float(_g(n).sum() - _g(n.sum(1)).sum() - _g(n.sum(0)).sum() + _g(n.sum()))


def gain_tables(n: np.ndarray, classes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both directions and each small count: what as many more bigrams with class x (or tokens at all) add for each class."""
    v = np.arange(_SMALL + 1.0)
    out = []
    for m in (n, n.T):
        left, total = m[:classes].T, m.sum(1)[:classes]
        out.append((_g(left + v[:, None, None]) - _g(left), _g(total + v[:, None]) - _g(total)))
    return out


def best_classes(n: np.ndarray, cls: np.ndarray, counts: np.ndarray, classes: int, tables: list | None = None) -> np.ndarray:
    """For each word the class that it alone would move to: of the first ``classes`` and its own the one of highest likelihood, its own among equals.

    ``counts`` has the word's followers by class, the tokens before it by class, and how often it follows itself.
    """
    tables = tables or gain_tables(n, classes)
    c, k, w = len(n), classes, np.arange(len(cls))
    o, i, self_ = counts[:, :c], counts[:, c : 2 * c], counts[:, -1]
    gain, own = np.zeros((len(cls), k)), np.zeros(len(cls))
    for m, mine, other, (cells, totals) in ((n, o, i, tables[0]), (n.T, i, o, tables[1])):
        at, x = np.nonzero(mine)
        v, a = mine[at, x], cls[at]
        same = x == a
        rows = np.empty((len(at), k))
        small = (v <= _SMALL) & ~same
        rows[small] = cells[v[small].astype(np.int64), x[small]]
        if len(rest := np.flatnonzero(~small)):
            # Counts of each class with x, without the word.
            left = m[:k, x[rest]].T - np.where(same[rest, None], other[at[rest], :k], 0)
            rows[rest] = _g(left + v[rest, None]) - _g(left)
        if len(at):
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            gain[at[first]] += np.add.reduceat(rows, first, axis=0)
        left = m[a, x] - v - same * (other[at, a] + self_[at])
        own += np.bincount(at, _g(left + v) - _g(left), len(cls))
        moved, total = mine.sum(1) + self_, m.sum(1)
        few = moved <= _SMALL
        gain[few] -= totals[moved[few].astype(np.int64)]
        gain[~few] -= _g(total[:k] + moved[~few, None]) - _g(total[:k])
        own -= _g(total[cls]) - _g(total[cls] - moved)
    # Bigrams of a class with itself got the word's two sides one by one.
    both = lambda d, x, y, s: _g(d + x + y + s) + _g(d) - _g(d + x) - _g(d + y)
    at, x = np.nonzero((o[:, :k] > 0) & (i[:, :k] > 0) | (self_[:, None] > 0))
    gain[at, x] += both(np.diag(n)[x], o[at, x], i[at, x], self_[at])
    own += both(np.diag(n)[cls] - o[w, cls] - i[w, cls] - self_, o[w, cls], i[w, cls], self_)
    inside = np.flatnonzero(cls < k)
    gain[inside, cls[inside]] = own[inside]
    return np.where(gain.max(1) > own + 1e-9, gain.argmax(1), cls)


def _draw(h: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each hash, another one for each salt."""
    x = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)) / float(1 << 53)


def _move(words: DataFrame, around: DataFrame, state: DataFrame, n: np.ndarray, share: float, salt: int) -> DataFrame:
    """The state after moves: those of all words without a cluster, and of a ``share`` of the others, chosen by hash."""
    shared = words.sparkSession.sparkContext.broadcast((n, gain_tables(n, CLASSES)))
    told = around.where("bucket >= 0").unionByName(state.select("place", "bucket", F.lit(-1).cast("long").alias("chunk"), "a", "b", F.lit(None).cast("binary").alias("c")))

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        b, n, tables = _Bucket(rows), *shared.value
        cells = known.filter(pc.greater_equal(known["chunk"], 0)).sort_by("chunk")
        known = known.filter(pc.less(known["chunk"], 0))
        counts, cls = chunks.unpack(known["a"][0].as_py(), "<i8"), chunks.unpack(known["b"][0].as_py(), "u1").astype(np.int64)
        free = (counts > 0) & ((cls > _END_CLASS) | (_draw(b.words, salt) < share))
        parts = [[], [], []]
        for chunk, each, slots, sums in zip(*(cells[x].to_pylist() for x in ("chunk", "a", "b", "c")), strict=True):
            who = np.repeat(b.at[chunk], chunks.unpack(each, "u1"))
            mine = free[who]
            for part, x in zip(parts, (who, chunks.unpack(slots, "u1"), chunks.unpack(sums)), strict=True):
                part.append(x[mine])
        if parts[0]:
            who, slots, sums = (np.concatenate(p) for p in parts)
            order = np.argsort(who, kind="stable")
            who, slots, sums = who[order], slots[order], sums[order]
            movers = np.unique(who)
            for at in range(0, len(movers), _STEP_WORDS):
                these = movers[at : at + _STEP_WORDS]
                i, j = np.searchsorted(who, [these[0], these[-1] + 1])
                dense = np.bincount(np.searchsorted(these, who[i:j]) * _SLOTS + slots[i:j], sums[i:j], len(these) * _SLOTS).reshape(len(these), _SLOTS)
                cls[these] = best_classes(n, cls[these], dense, CLASSES, tables)
        return _state(rows["place"][0].as_py(), rows["bucket"][0].as_py(), known["a"][0].as_py(), cls, "u1")

    return words.groupBy("place").cogroup(told.groupBy("place")).applyInArrow(run, _STATE)


def exchange(pairs: np.ndarray, moving: int, classes: int, rounds: int | None = None) -> np.ndarray:
    """The class of each item: the first ``moving`` items are clustered into ``classes``, every other item is its own class.

    Without ``rounds`` it goes on until no item moves.
    """
    items = len(pairs)
    cls = np.concatenate((np.arange(moving) % classes, classes + np.arange(items - moving)))
    c = classes + items - moving

    member = np.zeros((items, c))
    member[np.arange(items), cls] = 1
    out, inn = pairs @ member, pairs.T @ member
    n = member.T @ out
    k = np.arange(classes)
    for _ in itertools.count() if rounds is None else range(rounds):
        moved = 0
        for w in np.flatnonzero(pairs[:moving].sum(1) + pairs[:, :moving].sum(0) > 0):
            a, self_ = cls[w], pairs[w, w]
            o, i = out[w].copy(), inn[w].copy()
            o[a] -= self_
            i[a] -= self_
            n[a] -= o
            n[:, a] -= i
            n[a, a] -= self_
            rows, cols = n[:classes], n[:, :classes].T
            gain = (_g(rows + o) - _g(rows) + _g(cols + i) - _g(cols)).sum(1)
            d = n[k, k]
            gain += _g(d + o[k] + i[k] + self_) - _g(d) - (_g(d + o[k]) - _g(d)) - (_g(d + i[k]) - _g(d))
            r, s = rows.sum(1) + i[:classes], cols.sum(1) + o[:classes]  # with the pairs that the item itself has with a class
            gain -= _g(r + o.sum() + self_) - _g(r) + _g(s + i.sum() + self_) - _g(s)
            b = int(np.argmax(gain)) if gain.max() > gain[a] + 1e-9 else a
            n[b] += o
            n[:, b] += i
            n[b, b] += self_
            if b != a:
                moved += 1
                cls[w] = b
                out[:, a] -= pairs[:, w]
                out[:, b] += pairs[:, w]
                inn[:, a] -= pairs[w]
                inn[:, b] += pairs[w]
        if not moved:
            break
    return cls


@dataclass
class ClassModel:
    """What scoring needs besides words' classes and counts; sizes depend on the parameters only."""

    transition: np.ndarray  # log10 P(class | class before)
    mass: np.ndarray  # training tokens of each class
    total: int  # training tokens
    vocabulary: int  # distinct training tokens
    ends: int  # training texts

    def word(self, cls: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(word | its class): the end and the unseen word are alone in theirs."""
        return np.where(cls >= _UNSEEN, 1.0, np.where(cls == _END_CLASS, 1.0, counts / np.maximum(self.mass[cls], 1)))

    def score(self, cls: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and model score of texts, from the class and training count of their words one text after the other."""
        ends = np.cumsum(sizes + 1) - 1
        word = np.ones(len(cls) + len(sizes), dtype=bool)
        word[ends] = False
        c, k = np.full(len(word), float(self.ends)), np.full(len(word), _END_CLASS)
        c[word], k[word] = counts, cls
        before = np.concatenate(([_END_CLASS], k[:-1]))
        base = np.log10((c + 0.5) / (self.total + 0.5 * (self.vocabulary + 1)))
        own = self.transition[before, k] + np.log10(self.word(k, c))
        first = ends - sizes
        add = lambda x: np.add.reduceat(x, first) if len(first) else x
        return sizes + 1, add((c > 0).astype(np.int64)), add(base), add(own)


def _seen(n: np.ndarray) -> np.ndarray:
    """The bigrams without those of unseen words."""
    out = n.copy()
    out[_UNSEEN], out[:, _UNSEEN] = 0, 0
    return out


def _transition(n: np.ndarray) -> np.ndarray:
    """log10 P(class | class before).  The unseen word counts half as much as one word, and stands where words seen once do; classes without words have no share."""
    n = n.copy()
    n[:, _UNSEEN] *= 0.5 / max(1.0, n[:_UNSEEN, _UNSEEN].sum())
    mass = n[:_UNSEEN].sum(0)
    mass[[_END_CLASS, _UNSEEN]] = np.maximum(mass[[_END_CLASS, _UNSEEN]], 0.5)
    with np.errstate(divide="ignore"):
        return np.log10((n + PRIOR * mass / mass.sum()) / (n.sum(1, keepdims=True) + PRIOR))


def _drop(written: DataFrame) -> None:
    """Deletes a table that this run has materialized."""
    for f in written.inputFiles():
        path = written.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(written.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, False)


def _free_shuffles(df: DataFrame) -> None:
    """Spark deletes the shuffle files of a round once its collector finds that nothing refers to them."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _cluster(texts: DataFrame, words: DataFrame, counted: DataFrame, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """State (counts and classes of all words) and the class bigrams."""
    items = materialize(_items(words, counted, _frequent(counted)), "lm-items")
    cls = exchange(_bigrams(texts, _answers(words, items, "<i2")), FREQUENT, CLASSES).astype(np.uint8)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            codes = [chunks.pack(np.where(chunks.unpack(n, "<i8") > 0, cls[chunks.unpack(i, "<i2")], _UNSEEN), "u1") for n, i in rows]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(codes, pa.binary())], names=["place", "bucket", "a", "b"])

    state = materialize(items.mapInArrow(start, _STATE), "lm-words")
    around = materialize(_around(texts, _answers(words, state, "u1")), "lm-around")
    _drop(items)
    n, share = _class_bigrams(around), 0.0
    for turn in range(rounds):
        moved = materialize(_move(words, around, state, _seen(n), share, turn + 1), "lm-words")
        near = materialize(_around(texts, _answers(words, moved, "u1")), "lm-around")
        m = _class_bigrams(near)
        old, new = likelihood(_seen(n)), likelihood(_seen(m))
        if new >= old:
            (state, moved), (around, near), n = (moved, state), (near, around), m
        else:  # too many moved at once
            share /= 2
        _drop(near)
        _drop(moved)
        _free_shuffles(words)
        if turn and (0 <= new - old <= TOLERANCE * new or share < LEAST_SHARE):
            break
        share = share or 0.5
    _drop(around)
    return state, n


def score_documents(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score of every row; learns from the rows that ``train`` admits.

    Of the training rows come counts of all tokens; scores are log10 probabilities.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(train, F.lit(False)).alias("flag"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    dealt = chunks.deal(rows, _hashed, _number, chunks.buckets_of(docs)).persist(StorageLevel.DISK_ONLY)
    texts, words = dealt.where("place >= 0"), dealt.where("place < 0")
    counted = materialize(_count(words), "lm-counts")
    sums = counted.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    state, n = _cluster(texts, words, counted, rounds)
    ends = int(_seen(n)[:, _END_CLASS].sum())
    model = spark.sparkContext.broadcast(ClassModel(_transition(n), _seen(n).sum(0), int(sums.n or 0) + ends, int(sums.v or 0) + bool(ends), ends))

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        codes, _ = _codes(found, "a", "u1")
        counts, _ = _codes(found, "b", "<i8")
        m, ids, cols = model.value, [], [[np.zeros(0, t)] for t in (np.int64, np.int64, float, float)]
        for i in range(rows.num_rows):
            sizes, numbers = chunks.unpack(rows["a"][i].as_py()), chunks.unpack(rows["b"][i].as_py())
            ids.append(rows["ids"][i].values)
            for col, x in zip(cols, m.score((codes & (_ONCE - 1))[numbers], counts[numbers], sizes), strict=True):
                col.append(x)
        tokens, known, base, score = (np.concatenate(c) for c in cols)
        keys = pa.chunked_array(ids, rows["ids"].type.value_type)
        return pa.table([keys, pa.array(tokens.astype(np.int64)), pa.array(known), pa.array(np.full(len(tokens), m.total)), pa.array(base), pa.array(score)], names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = texts.groupBy("place").cogroup(_answers(words, state, "u1", with_counts=True).groupBy("place")).applyInArrow(run, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = materialize(out, "lm-scores")
    dealt.unpersist()
    _drop(state)
    _drop(counted)
    return out.withColumnRenamed("id", key)
