"""Toxicity by weak supervision.

Many voters look at a text.  Lexicon voters are words and word beginnings mined from labelled documents (a voter says
toxic when its word, or words with its beginning, occur at least so often); pattern voters look for signs in the text: lexicon
words close behind a second person, lexicon words in a row of three, dense ones, letters masked by signs, runs of exclamation
marks, capitals throughout; one says clean when there is no lexicon word.  A voter says toxic (1), clean (-1) or nothing (0).
The given label is one more voter.  A generative label model then estimates, by EM, how often each voter, the label among them,
says what in either class, and which voters are correlated given the class: correlated voters share their weight, so that many
forms of one word count once.  It learns from labelled and unlabelled documents alike.  A logistic regression on the votes,
without the label's, is trained on the model's posterior labels, and it alone scores texts.  A label that all other voters
contradict is outvoted: labels of this kind are partly wrong.

Learning reads at most ``FIT_DOCS`` labelled documents, chosen by a hash of the id, and ``FIT_UNLABELLED`` without a label.
``LEXICON`` voters are chosen, greedily, from the ``CANDIDATES`` strongest candidates; all these are parameters of train().
Scoring reads whole texts of any length.  Null and empty texts get the score of a text without votes.  Without labelled
toxic rows every score is 0.  Repeated rows get equal scores; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, unlabelled_sample

FIT_DOCS, FIT_UNLABELLED = 20_000, 5_000
#: Lexicon voters at most; documents of the class that a voter must be in; lengths of word beginnings; counts.
LEXICON = 96
SUPPORT = 4
STEMS = (4, 5, 6, 7)
TIMES = (1, 2, 3)
#: Log odds that a voter must reach.
ODDS = 2.5
#: Candidates whose documents are looked at one by one.
CANDIDATES = 1500
EM_STEPS = 40
#: How often a given label is taken to be right before the first step of EM.
LABEL_START = 0.95

_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][*@#$%]+[^\W\d_]")
_BANGS = re.compile(r"!{2,}")
#: Second persons, in the languages of the lexicon's texts.
_YOU = re.compile(r"\b(?:you|your|youre|ihr|du|dein|deine|tu|toi|vous|usted|eres)\b[^\w]+(?:\w+[^\w]+){0,3}$")
#: Characters before a lexicon word in which a second person is looked for.
_NEAR = 40
PATTERNS = ("none", "directed", "row", "dense", "masked", "bangs", "shouted")

#: (letters, whether they are a whole word, how often they must occur)
Voter = tuple[str, bool, int]


def _candidates(text: str | None) -> set[Voter]:
    """All voters that would say toxic of the text."""
    words = Counter(_WORD.findall((text or "").lower()))
    counts: Counter = Counter()
    for w, n in words.items():
        if len(w) >= 3:
            counts[w, True] += n
        for k in STEMS:
            if len(w) > k:
                counts[w[:k], False] += n
    return {(w, whole, k) for (w, whole), n in counts.items() for k in TIMES if n >= k}


def _matcher(lexicon: list[Voter]):
    import ahocorasick

    ids: dict[str, list[int]] = {}
    for i, (w, _, _) in enumerate(lexicon):
        ids.setdefault(w, []).append(i)
    a = ahocorasick.Automaton()
    for w, found in ids.items():
        a.add_word(w, (len(w), found))
    a.make_automaton()
    return a


@dataclass
class ToxicityModel:
    lexicon: list[Voter]
    weights: list[float] = field(default_factory=list)  # one for each feature, the bias last
    accuracies: list[tuple[float, float]] = field(default_factory=list)  # P(says toxic | toxic), P(says toxic | clean); the label's last
    _found: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_found": None}

    def votes(self, text: str | None) -> np.ndarray:
        """The lexicon's votes, then the patterns'."""
        n = len(self.lexicon)
        out = np.zeros(n + len(PATTERNS), dtype=np.int8)
        ends: list[int] = []
        directed = False
        if text and n:
            if self._found is None:
                self._found = _matcher(self.lexicon)
            low = text.lower()
            seen: Counter = Counter()
            for end, (size, ids) in self._found.iter(low):
                at = end - size + 1
                if at and low[at - 1].isalpha():
                    continue
                inside = end + 1 < len(low) and low[end + 1].isalpha()
                told = [i for i in ids if self.lexicon[i][1] != inside]
                if told:
                    seen.update(told)
                    ends.append(end)
                    directed = directed or bool(_YOU.search(low, max(0, at - _NEAR), at))
            for i, count in seen.items():
                out[i] = count >= self.lexicon[i][2]
        if text:
            places = np.unique(ends)
            upper = sum(text.count(c) for c in set(text) if c.isupper())
            out[n:] = [
                -1 if not ends else 0, directed, len(places) > 2 and bool((places[2:] - places[:-2] < 3 * _NEAR).any()), len(ends) * 400 > len(text) and bool(ends),
                _MASKED.search(text) is not None, _BANGS.search(text) is not None, upper * 2 > len(text),
            ]
        else:
            out[n] = -1
        return out

    def score(self, votes: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(votes))
        w = np.array(self.weights)
        return 1.0 / (1.0 + np.exp(-np.clip(votes @ w[:-1] + w[-1], -30, 30)))

    def udf(self):
        model = self

        @F.pandas_udf("double")
        def toxicity(texts: pd.Series) -> pd.Series:
            votes = np.stack([model.votes(t) for t in texts]) if len(texts) else np.zeros((0, len(model.lexicon) + len(PATTERNS)))
            return pd.Series(model.score(votes.astype(float)))

        return toxicity


def _mine(sample: DataFrame, lexicon: int, candidates: int) -> list[Voter]:
    """Voters that tell the classes apart, strongest first; those that only repeat others are passed over."""

    def counter(label: int, wanted: set[Voter] | None):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                seen: Counter = Counter()
                for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if (y > 0) == label:
                        found = _candidates(t)
                        seen.update(found if wanted is None else found & wanted)
                keys = list(seen)
                yield pa.record_batch([pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.int32()))] + [pa.array([seen[k] for k in keys], pa.int64())], names=["w", "whole", "k", "n"])

        return sample.mapInArrow(count, "w string, whole boolean, k int, n long").groupBy("w", "whole", "k").agg(F.sum("n").alias("n"))

    total = {bool(r.y): r.n for r in sample.groupBy((F.col("y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    pos, neg = total.get(True, 0), total.get(False, 0)
    if not pos:
        return []
    # What is collected here and below is bounded by the words of the sample's toxic documents.
    p = {(r.w, r.whole, r.k): r.n for r in counter(True, None).where(F.col("n") >= min(SUPPORT, pos)).collect()}
    n = {(r.w, r.whole, r.k): r.n for r in counter(False, set(p)).collect()}
    odds = {v: math.log((c + 0.5) / (pos + 1)) - math.log((n.get(v, 0) + 0.5) / (neg + 1)) for v, c in p.items()}
    best = sorted((v for v in p if odds[v] > ODDS), key=lambda v: (-odds[v] * math.sqrt(p[v]), v))[:candidates]
    among = set(best)

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {v: i for i, v in enumerate(best)}
        for b in batches:
            rows = [sorted(at[v] for v in _candidates(t) & among) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if y > 0]
            yield pa.record_batch([pa.array(rows, pa.list_(pa.int32()))], names=["v"])

    docs = sorted(tuple(r.v) for r in sample.mapInArrow(show, "v array<int>").collect())
    has: list[list[int]] = [[] for _ in best]
    for d, found in enumerate(docs):
        for i in found:
            has[i].append(d)
    # A document that voters speak for already counts half for each of them.
    weight, chosen = np.ones(len(docs)), []
    while len(chosen) < lexicon:
        gain = [0.0 if i in chosen else odds[v] * math.sqrt(weight[has[i]].sum()) * (weight[has[i]].sum() >= 1.5) for i, v in enumerate(best)]
        if not gain or max(gain) <= 0:
            break
        chosen.append(int(np.argmax(gain)))
        weight[has[chosen[-1]]] *= 0.5
    return [best[i] for i in chosen]


def label_model(votes: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row, P(vote | class) as [class, vote + 1, voter], and P(label says toxic | class).

    ``label`` is 1 or -1, or 0 where there is none; that a row has none tells nothing.
    """
    n, m = votes.shape
    says = np.stack([votes == v for v in (-1, 0, 1)]).astype(float)  # [vote, row, voter]
    given, toxic = label != 0, label > 0
    right = np.array([1 - LABEL_START, LABEL_START])  # P(label says toxic | class)
    seen = given.astype(float)  # rows without a label count from the first posterior on
    post = np.where(toxic, LABEL_START, 1 - LABEL_START)
    share = np.ones(m)
    for step in range(EM_STEPS):
        classes = np.stack([1 - post, post]) * seen
        prior = np.clip(classes.sum(1) / seen.sum(), 1e-3, 1 - 1e-3)
        p = (np.einsum("cr,vrm->cvm", classes, says) + 0.5) / (classes.sum(1)[:, None, None] + 1.5)
        told = classes * given
        if step:
            right = ((told * toxic).sum(1) + 0.5) / (told.sum(1) + 1.0)
        if step == EM_STEPS // 4:
            # Correlation given the class: of what each voter says beyond its mean in the class.
            left = (votes == 1) - (post[:, None] * p[1, 2] + (1 - post)[:, None] * p[0, 2])
            dev = left.std(0)
            rho = np.where(np.outer(dev, dev) > 1e-9, (left.T @ left) / n / np.maximum(np.outer(dev, dev), 1e-9), 0)
            np.fill_diagonal(rho, 0)
            share = 1.0 / (1.0 + np.where(rho > 0.3, rho, 0).sum(1))
        logp = np.log(prior) + np.einsum("vrm,cvm,m->rc", says, np.log(p), share)
        logp += given[:, None] * np.log(np.where(toxic[:, None], right, 1 - right))
        post = 1.0 / (1.0 + np.exp(np.clip(logp[:, 0] - logp[:, 1], -30, 30)))
        seen = np.ones(n)
    return post, p, right


def _logistic(x: np.ndarray, target: np.ndarray, ridge: float = 0.2) -> np.ndarray:
    """Ridge logistic regression on soft labels, by Newton steps; the bias is last and free."""
    x = np.column_stack([x, np.ones(len(x))])
    w, reg = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    reg[-1] = 1e-3
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(reg), x.T @ (target - p) - reg * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(
    docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCS, key: str = "doc_id", text: str = "text", label: str = "toxic", unlabelled: int = FIT_UNLABELLED, lexicon: int = LEXICON, candidates: int = CANDIDATES
) -> ToxicityModel:
    sample = labelled_sample(docs, labels, label, limit, key, text)
    model = ToxicityModel(_mine(sample, lexicon, candidates))
    if not model.lexicon:
        return model
    rest = unlabelled_sample(docs, labels, label, unlabelled, key, text)
    told = sample.select("text", F.when(F.col("y") > 0, 1).otherwise(-1).alias("y")).unionByName(rest.select("text", F.lit(0).alias("y")))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array([model.votes(t).tobytes() for t in b.column(0).to_pylist()], pa.binary()), b.column(1)], names=["v", "y"])

    # A few dozen bytes for each of at most `limit` + `unlabelled` rows.
    rows = told.mapInArrow(vote, "v binary, y int").toPandas()
    votes = np.stack([np.frombuffer(v, dtype=np.int8) for v in rows.v])
    order = np.lexsort(np.column_stack([votes, rows.y]).T)  # the same sums whatever the order of rows
    votes, y = votes[order], rows.y.to_numpy()[order]
    post, p, right = label_model(votes, y)
    model.weights = [float(w) for w in _logistic(votes.astype(float), post)]
    model.accuracies = [(float(a), float(b)) for a, b in zip([*p[1, 2], right[1]], [*p[0, 2], right[0]], strict=True)]
    return model


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score"""
    return docs.select(F.col(key), model.udf()(F.col(text)).alias("score"))
