"""Near-duplicate vectors by spherical-cap filters.

Filter directions are the products of two codebooks: a vector's halves (after a fixed random rotation) are compared with
the unit codewords of one codebook each, and a pair of codewords is a filter of the vector when the sum of its two inner
products exceeds a threshold.  The pairs are list-decoded from the sorted inner products, without looking at all products.
Vectors that share a filter and a label are compared in double precision; a pair is counted in the first filter it shares.

The threshold is set so that about ``FILTERS`` directions take a vector, measured on random vectors of the same dimension; one
that fewer than ``LEAST`` take gets its best ``LEAST``.  Directions grow with the number of vectors, so lists stay short, but
only as far as their caps stay twice as wide as a link, which matters up to some 30 dimensions.  In ``FEW`` dimensions or less
caps can't be both, and the filters are cells of the first coordinates instead: a vector takes every cell that a vector linked
with it may lie in, so no link is lost.  Lists longer than ``BLOCK`` are cut into blocks, and each pair of blocks is a task's
work of its own: the number of links asks for every pair of a group of near copies, in matrix products of blocks.  Equal vectors
with equal labels are compared once.

Links need equal labels that are not null.  Vectors that are null, zero, empty or hold null, NaN or infinity link with
nothing; vectors of different length don't link.  Rows with one id are all counted as vectors.  A null id is kept as a row with
a null component.  Ids may be of any type that sorts, components have it too.  Empty tables give empty results.  Only id, vector and label are read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

FILTERS = 16
LEAST = 8
#: Codewords of each codebook at least; directions are their square.
CODES = 256
BLOCK = 1024
#: Up to so many dimensions filters are cells, of so many coordinates at most.
FEW, CELL_COORDINATES = 12, 5
#: Sine of the least angle of a cap: over twice the angle of the default link.
CAP_SINE = math.sin(math.radians(25))
#: Inner products with a codebook that are held at once: codebooks grow with the table, memory doesn't.
STEP_PRODUCTS = 1 << 20


def codes_of(dim: int, codes: int) -> int:
    """Codewords of each codebook: a cap that takes FILTERS of all directions keeps an angle of CAP_SINE."""
    most = math.log(FILTERS) / 2 - (dim - 1) / 2 * math.log(CAP_SINE)
    return codes if most > math.log(codes) else max(LEAST, int(math.exp(most)))


@lru_cache(maxsize=16)
def _codebooks(dim: int, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """A rotation, two codebooks of unit vectors and the bar that about FILTERS directions exceed, the same everywhere."""
    rng = np.random.default_rng(dim * 1_000_003 + codes)
    turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    half = max(1, dim // 2)
    a, b = rng.standard_normal((codes, half)), rng.standard_normal((codes, max(1, dim - half)))
    a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    x = rng.standard_normal((64, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = min(codes, FILTERS)  # the best FILTERS sums are of the best so many on either side
    p, q = -np.sort(-(x[:, :half] @ a.T), axis=1)[:, :k], -np.sort(-(x[:, half:] @ b.T), axis=1)[:, :k]
    sums = np.sort((p[:, :, None] + q[:, None, :]).reshape(len(x), -1), axis=1)
    return turn, a, b, float(np.median(sums[:, -min(FILTERS, sums.shape[1])]))


def filters_of(unit: np.ndarray, codes: int, least: float = 0.98) -> list[np.ndarray]:
    """The ascending filters that take each unit vector."""
    dim = unit.shape[1]
    if dim <= FEW:
        return _cells(unit, least)
    codes = codes_of(dim, codes)
    rows = max(1, STEP_PRODUCTS // codes)
    return [f for at in range(0, len(unit), rows) for f in _filters(unit[at : at + rows], codes)]


def _cells(unit: np.ndarray, least: float) -> list[np.ndarray]:
    """Numbers of the cells that a link's length reaches from each vector, by the first coordinates."""
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    x = unit[:, :CELL_COORDINATES]
    low, high = (np.floor((x + s * reach) / (2 * reach)).astype(np.int64) for s in (-1, 1))
    side = int(math.ceil(1.5 / reach)) + 3  # cells in each direction, and room for negative numbers
    out = np.zeros((len(x), 0), np.int64)
    parts = []
    for pick in itertools.product((0, 1), repeat=x.shape[1]):
        cell = np.where(np.array(pick), high, low) + side // 2 + 1
        parts.append(cell @ (side**np.arange(x.shape[1])))
    out = np.stack(parts, axis=1)
    return [np.unique(r) for r in out]


def _filters(unit: np.ndarray, codes: int) -> list[np.ndarray]:
    dim = unit.shape[1]
    turn, left, right, bar = _codebooks(dim, codes)
    x = unit @ turn
    half = left.shape[1]
    p, q = x[:, :half] @ left.T, x[:, half:] @ right.T
    po, qo = np.argsort(-p, axis=1, kind="stable"), np.argsort(-q, axis=1, kind="stable")
    ps, qs = np.take_along_axis(p, po, 1), np.take_along_axis(q, qo, 1)
    out = []
    for r in range(len(x)):
        rows = int(np.searchsorted(-ps[r], qs[r, 0] - bar, side="right"))
        counts = np.searchsorted(-qs[r], ps[r, :rows] - bar, side="right")
        if counts.sum() < LEAST:
            k = min(LEAST, codes)
            sums = ps[r, :k, None] + qs[r, None, :k]
            best = np.argsort(-sums, axis=None, kind="stable")[: min(LEAST, k * k)]
            i, j = po[r, best // k], qo[r, best % k]
        else:
            i = np.repeat(po[r, :rows], counts)
            j = np.concatenate([qo[r, :c] for c in counts])
        out.append(np.sort(i.astype(np.int64) * codes + j))
    return out


def _decode(vectors: DataFrame, codes: int, least: float) -> DataFrame:
    """id, label, weight, dim, x (bytes of doubles of the unit vector), fs (its filters); vectors that can't link are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_dim: dict[int, list[int]] = {}
            rows = b.column(3).to_pylist()
            units: dict[int, np.ndarray] = {}
            for i, v in enumerate(rows):
                if v and None not in v:
                    x = np.array(v, dtype=np.float64)
                    top = np.abs(x).max()
                    if np.isfinite(x).all() and top > 0:
                        x = x / top
                        units[i] = x / np.sqrt(x @ x)
                        by_dim.setdefault(len(v), []).append(i)
            for dim, at in by_dim.items():
                x = np.stack([units[i] for i in at])
                fs = filters_of(x, codes, least)
                take = pa.array(at)
                yield pa.record_batch(
                    [b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array([dim] * len(at), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(fs, pa.list_(pa.int64()))],
                    names=["id", "label", "weight", "dim", "x", "fs"],
                )

    s = vectors.schema
    return vectors.select("id", "label", "weight", "v").mapInArrow(run, f"id {s['id'].dataType.simpleString()}, label {s['label'].dataType.simpleString()}, weight long, dim int, x binary, fs array<long>")


def _linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x and y have a cosine of at least ``least``."""
    c = x @ y.T
    out = c >= least
    # Close calls are decided by one sum for each pair, not by the blocked product.
    i, j = np.nonzero(np.abs(c - least) < 1e-9)
    if len(i):
        out[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= least
    return out


def _shares_lower(fs: list[np.ndarray], gs: list[np.ndarray], f: int) -> np.ndarray:
    """Which pairs share a filter below f: they were counted there."""
    low = [[np.asarray(a, dtype=np.int64) for a in side] for side in (fs, gs)]
    low = [[a[: np.searchsorted(a, f)] for a in side] for side in low]
    both = np.intersect1d(*(np.concatenate([np.zeros(0, np.int64), *side]) for side in low))
    marks = []
    for side in low:
        m = np.zeros((len(side), len(both)), dtype=np.float32)
        row, flat = np.repeat(np.arange(len(side)), [len(a) for a in side]), np.concatenate([np.zeros(0, np.int64), *side])
        at = np.searchsorted(both, flat)
        has = at < len(both)
        has[has] = both[at[has]] == flat[has]
        m[row[has], at[has]] = 1
        marks.append(m)
    return marks[0] @ marks[1].T > 0


def _links(lists: DataFrame, least: float) -> DataFrame:
    """id, links (in this list first), root (a linked id) for the linked vectors of every list."""
    kind = lists.schema["id"].dataType.simpleString()

    def of_list(t: pa.Table) -> tuple | None:
        if t.num_rows < 2:
            return None
        col = lambda name: t.column(name).to_numpy()
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), dtype=np.float64).reshape(t.num_rows, -1)
        bi, bj, f = t.column("bi")[0].as_py(), t.column("bj")[0].as_py(), t.column("f")[0].as_py()
        a = np.arange(t.num_rows) if bi == bj else np.flatnonzero(col("block") == bi)
        b = a if bi == bj else np.flatnonzero(col("block") == bj)
        linked = _linked(x[a], x[b], least)
        if bi == bj:
            linked = np.triu(linked, 1)
        ia, jb = np.nonzero(linked)
        if not len(ia):
            return None
        i, j = a[ia], b[jb]
        ra, rb = np.unique(ia), np.unique(jb)  # rows that link at all
        fs = t.column("fs").to_numpy()
        first = linked[np.ix_(ra, rb)] & ~_shares_lower(list(fs[a[ra]]), list(fs[b[rb]]), f)
        w = col("weight").astype(np.int64)
        links = np.zeros(t.num_rows, dtype=np.int64)
        np.add.at(links, a[ra], first @ w[b[rb]])
        np.add.at(links, b[rb], first.T @ w[a[ra]])
        root = np.arange(t.num_rows)
        while True:  # the smallest row that each row reaches inside the list
            m = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, m)
            np.minimum.at(new, j, m)
            new = new[new]
            if (new == root).all():
                break
            root = new
        used = np.unique(np.concatenate((i, j)))
        ids = t.column("id").combine_chunks()
        return ids.take(pa.array(used)), pa.array(links[used]), ids.take(pa.array(root[used]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        names = ("label", "dim", "f", "bi", "bj")
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            # Numbers of labels, so that labels of any type compare.
            keys = np.column_stack([t.column(c).combine_chunks().dictionary_encode().indices.to_numpy() if c == "label" else t.column(c).to_numpy() for c in names])
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()]
            found = [r for p, q in zip(edges[:-1], edges[1:], strict=True) if (r := of_list(t.slice(p, q - p)))]
            held = t.slice(edges[-1])
            if found:
                yield pa.record_batch([pa.concat_arrays([r[k] for r in found]) for k in range(3)], names=["id", "links", "root"])
        if held is not None and (r := of_list(held)):
            yield pa.record_batch(list(r), names=["id", "links", "root"])

    placed = lists.repartition("label", "dim", "f", "bi", "bj").sortWithinPartitions("label", "dim", "f", "bi", "bj", "id")
    return placed.mapInArrow(run, f"id {kind}, links long, root {kind}")


def dedup_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """key, n_links (other vectors linked directly), component_id and kept of every row."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    able = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("id").isNotNull())
    # Equal vectors are one class; its number is a hash of all that makes it equal.
    classes = materialize(able.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "caps-classes")
    codes = max(CODES, math.isqrt(4 * classes.count()))
    decoded = materialize(_decode(classes, codes, least), "caps-filters")
    entries = decoded.select("id", "label", "dim", F.explode("fs").alias("f"))
    lists = entries.groupBy("label", "dim", "f").agg(F.count("*").alias("size")).where("size > 1").select("label", "dim", "f", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    # Only filters with company are worth a vector's bytes.
    used = entries.join(lists, ["label", "dim", "f"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    used = used.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    used = used.select("id", "f", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    lists = used.join(decoded, "id").select("label", "dim", "f", "bi", "bj", "block", "id", "weight", "x", "fs")
    found = materialize(_links(lists, least), "caps-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "caps-components").withColumnRenamed("component", "comp")
    told = classes.join(decoded.select("id", F.lit(True).alias("able")), "id", "left").join(links, "id", "left").join(comps, "id", "left")
    told = told.select("label", "v", F.col("id").alias("cid"), "weight", "able", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "id").alias("comp"))
    out = rows.join(told, (rows.label == told.label) & (rows.v == told.v) & rows.id.isNotNull(), "left").drop(told.label, told.v)
    n = F.when(F.col("able"), F.col("links") + F.col("weight") - 1).otherwise(0).cast("long")
    comp = F.when(F.col("able"), F.col("comp")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), n.alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"))
