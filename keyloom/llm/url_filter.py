"""URL filter by a bit-parallel wildcard automaton.

Glob rules are compiled into one multiword Shift-And automaton: every rule owns a run of bits, one bit per state, and a
table per character class says which states a character enters and in which states it loops.  All rules advance together
with two shifts and two masks per character, for many URLs at a time (the columns of a batch, longest URLs first).

Pattern language, anchored at both ends: ``*`` any run of characters, ``+`` any run of characters other than ``/``,
``?`` one character, everything else itself.  ``\\`` quotes the next character.

Canonical form: ``.`` + host (A-Z lower-cased) + path, without scheme, query and fragment; null or a url without ``://``
is the empty string.  Null, empty, very long and repeated URLs are ordinary rows; an empty table gives an empty result.
Equal URLs get equal verdicts.  Of the rules that match, the one with the highest priority wins, then the first given.
Columns other than the key and the URL are not carried, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOOP_NONE, _LOOP_ANY, _LOOP_SEGMENT = 0, 1, 2
#: URL characters advanced at once; bounds the state arrays of a step.
_STEP_URLS = 4096


@dataclass(frozen=True)
class GlobRule:
    pattern: str
    verdict: str
    priority: int = 0
    #: What the result names the rule; None for rules that only carry a verdict.
    name: str | None = None


def host_path_rule(host: str, path: str, verdict: str) -> GlobRule:
    """A rule for a host, its subdomains and all paths below a prefix; longer rules win."""
    quote = lambda s: "".join("\\" + c if c in "*+?\\" else c for c in s)
    return GlobRule(f"+.{quote(host)}{quote(path)}*", verdict, 1_000 + len(host) + len(path), host + path)


def _parse(pattern: str) -> tuple[list[str | None], list[int]]:
    """The character (None: any) that enters each state after the first, and the loop of every state."""
    chars: list[str | None] = []
    loops = [_LOOP_NONE]
    it = iter(pattern)
    for c in it:
        if c == "*":
            loops[-1] = _LOOP_ANY
        elif c == "+":
            loops[-1] = max(loops[-1], _LOOP_SEGMENT) if loops[-1] != _LOOP_ANY else _LOOP_ANY
        else:
            chars.append(None if c == "?" else next(it, "\\") if c == "\\" else c)
            loops.append(_LOOP_NONE)
    return chars, loops


class Automaton:
    """Masks of all rules over 64-bit words; rules are kept in the order in which they win."""

    def __init__(self, rules: Iterable[GlobRule]):
        self.rules = sorted(rules, key=lambda r: -r.priority)
        parsed = [_parse(r.pattern) for r in self.rules]
        states = sum(len(loops) for _, loops in parsed)
        self.words = max(1, -(-states // 64))
        alphabet = sorted({c for chars, _ in parsed for c in chars if c is not None} | {"/"})
        self.alphabet = np.array([ord(c) for c in alphabet], dtype=np.uint32)
        enter = np.zeros((len(alphabet) + 1, states), dtype=bool)  # the last class: all other characters
        loop = np.zeros_like(enter)
        slash = alphabet.index("/")
        start, self.final = [], []
        at = 0
        for chars, loops in parsed:
            start.append(at)
            for i, kind in enumerate(loops):
                if kind:
                    loop[:, at + i] = True
                if kind == _LOOP_SEGMENT:
                    loop[slash, at + i] = False
            for i, c in enumerate(chars):
                enter[slice(None) if c is None else alphabet.index(c), at + i + 1] = True
            at += len(loops)
            self.final.append(at - 1)
        self.enter, self.loop = self._pack(enter), self._pack(loop)
        first = np.zeros((1, states), dtype=bool)
        first[0, start] = True
        self.start = self._pack(first)[0]

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(bits), self.words * 64), dtype=bool)
        padded[:, : bits.shape[1]] = bits
        return np.packbits(padded, axis=1, bitorder="little").view("<u8")

    def _classes(self, text: str) -> np.ndarray:
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, cp), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == cp, at, len(self.alphabet)).astype(np.intp)

    def match(self, urls: list[str]) -> np.ndarray:
        """The index in self.rules of the rule that wins for each canonical URL, or -1."""
        out = np.full(len(urls), -1, dtype=np.int64)
        for at in range(0, len(urls), _STEP_URLS):
            out[at : at + _STEP_URLS] = self._match(urls[at : at + _STEP_URLS])
        return out

    def _match(self, urls: list[str]) -> np.ndarray:
        lengths = np.array([len(u) for u in urls], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        flat = self._classes("".join(urls[i] for i in order))
        offsets = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        state = np.tile(self.start, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        for j in range(int(lengths[0]) if len(urls) else 0):
            live = int(np.searchsorted(-lengths, -j, side="left"))  # URLs longer than j
            c = flat[offsets[:live] + j]
            s = state[:live]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            state[:live] = (moved & self.enter[c]) | (s & self.loop[c])
        won = np.full(len(urls), -1, dtype=np.int64)
        for k in reversed(range(len(self.rules))):
            bit = self.final[k]
            won[(state[:, bit // 64] >> np.uint64(bit % 64)) & one == one] = k
        out = np.empty(len(urls), dtype=np.int64)
        out[order] = won
        return out


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path of a URL as columns; both empty for null and without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judge_urls(df: DataFrame, rules: Iterable[GlobRule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Key, host, path, rule (name of the winning rule, else null), verdict and the winning pattern of every row."""
    automaton = Automaton(list(rules))
    host, path = host_and_path(F.col(url))
    canonical = df.select(F.col(key), host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, p = b.column(1).to_pylist(), b.column(2).to_pylist()
            won = automaton.match(["." + x + y if x or y else "" for x, y in zip(h, p, strict=True)])
            rule = [automaton.rules[k] if k >= 0 else None for k in won]
            yield pa.record_batch(
                [*b.columns, pa.array([r and r.name for r in rule], pa.string()), pa.array([r.verdict if r else default for r in rule], pa.string()), pa.array([r and r.pattern for r in rule], pa.string())],
                names=["key", "host", "path", "rule", "verdict", "pattern"],
            )

    kind = df.schema[key].dataType.simpleString()
    out = canonical.mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string, pattern string")
    return out.withColumnRenamed("key", key)
