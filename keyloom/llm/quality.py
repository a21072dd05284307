"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad.  Its features are rates of kinds of characters, word lengths, repeated
words and repeated lines, and the same of the lines before and after; the chain adds a score for each pair of
neighbouring labels.  The forward-backward algorithm gives each line's probability of being good, and the mean of these,
weighted by line length, is the document's quality.

Training: lines take their document's label; gradient ascent on the likelihood (Adam) over the lines of at most
``FIT_DOCS`` labelled documents, chosen by a hash of the id, of longer ones ``FIT_LINES`` lines in a row, at a place chosen by the text.  Scoring reads whole texts, whatever their length.

Null and empty texts, and texts without a word, have no lines: their score is the share of good documents in training.
Without labelled rows every score is 1 and nothing is rejected.  Repeated rows get equal scores; empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import labelled_sample

FIT_DOCS = 6_000
FIT_LINES = 1_000
STEPS = 150
THRESHOLD = 0.3

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "symbol": b"*#$%&@^~=+<>{}[]\\_", "bang": b"!?", "pipe": b"|", "digit": b"0123456789", "stop": b".,;:"}
_RATES = [*_KINDS, "high"]
#: A rate of one over this is well in the bend of tanh.
_SCALE = {"upper": 4.0, "symbol": 16.0, "bang": 8.0, "pipe": 16.0, "digit": 4.0, "stop": 4.0, "high": 1.0}
BASE = [*_RATES, "word_length", "repeated_word", "repeated_line", "short"]
#: The base features of the line, of the line before and of the line after, and a constant.
N_FEATURES = 3 * len(BASE) + 1


def _class_table() -> np.ndarray:
    out = np.full(256, len(_KINDS) + 1, dtype=np.intp)  # other
    for i, chars in enumerate(_KINDS.values()):
        out[list(chars)] = i
    out[128:] = len(_KINDS)
    return out


_CLASS = _class_table()


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a word, their lengths in bytes, and the first line of each text (one more entry)."""
    data, starts, ends, h, first = wordhash.words(texts)
    n = len(texts)
    if not len(starts):
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0), np.zeros(n + 1, np.int64)
    owner = np.repeat(np.arange(n), np.diff(first))
    breaks = np.concatenate(([0], np.cumsum(data == 10)))[starts]  # line feeds before each word
    new = np.concatenate(([True], (breaks[1:] != breaks[:-1]) | (owner[1:] != owner[:-1])))
    line_of = np.cumsum(new) - 1  # the line of each word
    at = np.flatnonzero(new)
    words = np.diff(np.concatenate((at, [len(starts)])))
    begin, end = starts[at], ends[at + words - 1]
    doc = owner[at]
    length = (end - begin).astype(float)
    feats = np.zeros((len(at), len(BASE)), np.float32)
    kinds = _CLASS[data]
    for i in range(len(_RATES)):
        sums = np.concatenate(([0], np.cumsum(kinds == i)))
        feats[:, i] = np.tanh(_SCALE[_RATES[i]] * (sums[end] - sums[begin]) / length)
    i = len(_RATES)
    feats[:, i] = np.tanh(np.bincount(line_of, ends - starts, len(at)) / words / 10.0)
    same = np.concatenate(([False], (h[1:] == h[:-1]) & ~new[1:]))
    feats[:, i + 1] = np.tanh(4.0 * np.bincount(line_of, same, len(at)) / words)
    # A line is known by the sum of its words' hashes.
    sig = np.add.reduceat(h, at)
    order = np.lexsort((sig, doc))
    again = np.zeros(len(at), dtype=bool)
    again[order[1:]] = (sig[order[1:]] == sig[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    feats[:, i + 2] = again
    feats[:, i + 3] = words < 4
    before, after = np.zeros_like(feats), np.zeros_like(feats)
    joined = doc[1:] == doc[:-1]
    before[1:][joined] = feats[:-1][joined]
    after[:-1][joined] = feats[1:][joined]
    return np.concatenate((feats, before, after, np.ones((len(at), 1), np.float32)), axis=1), length, np.searchsorted(doc, np.arange(n + 1))


def forward_backward(unary: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line; expected label pairs of all chains, [2, 2]; log partition of each chain.

    unary: score of good of each line (bad: 0); pair[a, b]: score of label a before label b; first: as line_features gives it.
    All chains advance together, the longest first.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    at = first[:-1][order]
    chains = int((size > 0).sum())
    u = np.stack([np.zeros_like(unary), unary], axis=1)
    alpha, beta = np.zeros_like(u), np.zeros_like(u)
    live = [chains]
    alpha[at[:chains]] = u[at[:chains]]
    for t in range(1, int(size[0]) if chains else 0):
        k = int(np.searchsorted(-size, -t, side="left"))
        live.append(k)
        rows = at[:k] + t
        prev = alpha[rows - 1]
        alpha[rows] = u[rows] + np.logaddexp(prev[:, :1] + pair[0], prev[:, 1:] + pair[1])
    expected = np.zeros((2, 2))
    log_z = np.zeros(len(size))
    last = at[:chains] + size[:chains] - 1
    log_z[order[:chains]] = np.logaddexp(alpha[last, 0], alpha[last, 1])
    z = np.zeros(len(size))
    z[:chains] = log_z[order[:chains]]
    for t in reversed(range(1, len(live))):
        k = live[t]
        rows = at[:k] + t
        nxt = u[rows] + beta[rows]
        step = pair[None] + nxt[:, None, :]
        beta[rows - 1] = np.logaddexp(step[:, :, 0], step[:, :, 1])
        expected += np.exp(alpha[rows - 1][:, :, None] + step - z[:k, None, None]).sum(0)
    good = 1.0 / (1.0 + np.exp(np.clip(alpha[:, 0] + beta[:, 0] - alpha[:, 1] - beta[:, 1], -50, 50)))
    return good, expected, log_z


@dataclass
class QualityModel:
    weights: list[float] = field(default_factory=list)
    pair: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])
    empty: float = 1.0

    def lines(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, line lengths, first line of each text."""
        x, length, first = line_features(texts)
        return forward_backward(x @ np.array(self.weights), np.array(self.pair), first)[0], length, first

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.empty)
        if not self.weights:
            return out
        for at, part in wordhash.steps(texts):
            good, length, first = self.lines(part)
            owner = np.repeat(np.arange(len(part)), np.diff(first))
            total = np.bincount(owner, length, len(part))
            mean = np.bincount(owner, length * good, len(part)) / np.maximum(total, 1)
            out[at : at + len(part)] = np.where(total > 0, np.clip(mean, 0, 1), self.empty)
        return out

    def udf(self):
        model = self

        @F.pandas_udf("double")
        def quality(texts: pd.Series) -> pd.Series:
            return pd.Series(model.score(pa.array(texts, pa.large_string(), from_pandas=True)))

        return quality


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = STEPS, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and label-pair scores that maximise the mean likelihood of the chains' labels."""
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    label = y[owner].astype(float)
    n = max(1, len(x))
    pairs = np.zeros((2, 2))
    for c in (0, 1):
        pairs[c, c] = np.maximum(size[y == c] - 1, 0).sum()
    observed = x.T @ label
    params = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        good, expected, _ = forward_backward(x @ params[:-4], params[-4:].reshape(2, 2), first)
        g = np.concatenate((observed - x.T @ good, (pairs - expected).ravel())) / n - ridge * params
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return params[:-4], params[-4:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCS, key: str = "doc_id", text: str = "text", label: str = "quality", lines: int = FIT_LINES) -> QualityModel:
    sample = labelled_sample(docs, labels, label, limit, key, text)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in wordhash.steps(b.column(0)):
                x, _, first = line_features(part)
                size = np.diff(first)
                start = first[:-1] + np.array([zlib.crc32(x[i : i + 1].tobytes()) for i in first[:-1]], dtype=np.int64) % np.maximum(size - lines + 1, 1)
                blobs = [x[i : i + min(n, lines)].astype(np.float32).tobytes() for i, n in zip(start, size, strict=True)]
                yield pa.record_batch([pa.array(blobs, pa.binary()), b.column(1).slice(at, len(part))], names=["x", "y"])

    rows = sample.mapInArrow(features, "x binary, y int").toPandas()
    if not len(rows):
        return QualityModel()
    rows = rows.iloc[np.lexsort((rows.y, rows.x.map(zlib.crc32)))]  # the same sums whatever the order of rows
    y = (rows.y.to_numpy() > 0).astype(int)
    parts = [np.frombuffer(b, dtype=np.float32).reshape(-1, N_FEATURES) for b in rows.x]
    x = np.concatenate(parts).astype(float)
    if not len(x):
        return QualityModel(empty=float(y.mean()))
    w, pair = fit(x, np.concatenate(([0], np.cumsum([len(p) for p in parts]))), y)
    return QualityModel([float(a) for a in w], [[float(a) for a in r] for r in pair], float(y.mean()))


def score(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score"""
    return docs.select(F.col(key), model.udf()(F.col(text)).alias("score"))
