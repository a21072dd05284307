"""Vectorised word and shingle hashes over Arrow string arrays.

Words are maximal runs of bytes other than space and 0x09-0x0D; A-Z is lower-cased.  A word's hash is a polynomial over a
random 64-bit value per byte, taken from running sums over the whole buffer, so no Python object is made per word.
Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import STEP_BYTES

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SEP = np.zeros(256, dtype=bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_A, _B = np.uint64(0xD1B54A32D192ED03), np.uint64(0xAEF17502108EF2D9)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = int(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, STEP_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def steps(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) with at most STEP_BYTES of text each, or one row."""
    sizes = np.zeros(len(texts), dtype=np.int64)
    if len(texts):
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(texts):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), STEP_BYTES, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


def of_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each slice of a byte buffer; capital letters count as small ones."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[data] * _power(_P, len(data)), dtype=np.uint64)))
    h = (sums[ends] - sums[starts]) * _power(_P_INV, len(data) + 1)[starts]
    return mix(h ^ (ends - starts).astype(np.uint64))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, starts and ends of words in it, word hashes, and the first word of each text (one more entry than texts)."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if n else np.zeros(1, np.int64)
    if not len(data):
        z = np.zeros(0, dtype=np.int64)
        return data, z, z, np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    sep = _SEP[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([True], sep[:-1])) | edge[:-1]
    after = np.concatenate((sep[1:], [True])) | edge[1:]
    starts, ends = np.flatnonzero(~sep & before), np.flatnonzero(~sep & after) + 1
    return data, starts, ends, of_slices(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle of so many words; a text with fewer words but at least one is one shingle."""
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(h) >= width:
        m = len(h) - width + 1
        s = np.zeros(m, dtype=np.uint64)
        for i in range(width):
            s = s * _A + h[i : i + m] * _B
        ok = owner[:m] == owner[width - 1 :]
        out, who = mix(s[ok]), owner[:m][ok]
    else:
        out, who = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for i in range(width - 1):
            has = counts[short] > i
            extra[has] = extra[has] * _A + h[first[short[has]] + i] * _B
        extra = mix(extra + counts[short].astype(np.uint64))
        out, who = np.concatenate((out, extra)), np.concatenate((who, short))
        order = np.argsort(who, kind="stable")
        out, who = out[order], who[order]
    return out, who


def distinct_per_text(out: np.ndarray, who: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, one text after the other, and where each text begins."""
    order = np.lexsort((out, who))
    out, who = out[order], who[order]
    if len(out):
        keep = np.concatenate(([True], (out[1:] != out[:-1]) | (who[1:] != who[:-1])))
        out, who = out[keep], who[keep]
    return out, np.searchsorted(who, np.arange(n + 1))
