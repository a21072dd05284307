"""Texts as chunks of word numbers, and their distinct words dealt out by hash.

A task turns its texts into chunks of about ``CHUNK_TOKENS`` words.  A chunk numbers its distinct words in the order of their
hashes; its texts become rows of word numbers, one for each step of texts, and its distinct words become one row for each
hash range (bucket).  Rows carry a ``place``: the chunk for texts, -1 - bucket for words.  Dealt out by place, all that the
corpus has of a word meets in one task, where it is worked on once; what comes of it goes back to each chunk as one row for
each bucket, in the order of the words' numbers, so answers need neither hashes nor positions.

Only compressed blobs are shuffled: numbers as byte planes under zstandard.  A frequent word is in a chunk's table once, so
no bucket is hotter than another.  Rows must come in the same order when a task is repeated, as those of a scan do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import wordhash
from .common import shuffle_partitions

CHUNK_TOKENS = 1 << 21
#: Buckets for each shuffle partition.
BUCKETS_PER_PARTITION = 2


@lru_cache(maxsize=1)
def _codecs():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(data: bytes) -> bytes:
    return _codecs()[0].compress(data)


def expand(blob: bytes) -> bytes:
    return _codecs()[1].decompress(blob)


def pack(numbers: np.ndarray, kind: str = "<i4") -> bytes:
    """Numbers as byte planes, compressed."""
    a = np.ascontiguousarray(numbers, dtype=kind)
    return squeeze(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpack(blob: bytes, kind: str = "<i4") -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(expand(blob), dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def bucket_edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in ascending 64-bit hashes (one more entry than buckets)."""
    width = (1 << 64) // buckets + 1
    return np.searchsorted(hashes, np.array([min(i * width, (1 << 64) - 1) for i in range(buckets)], dtype=np.uint64)).tolist() + [len(hashes)]


def buckets_of(df: DataFrame) -> int:
    return BUCKETS_PER_PARTITION * shuffle_partitions(df.sparkSession)


def schema_of(docs: DataFrame) -> str:
    return f"place long, bucket int, ids array<{docs.schema['id'].dataType.simpleString()}>, a binary, b binary, c binary"


def deal(docs: DataFrame, split: Callable, number: Callable, buckets: int) -> DataFrame:
    """Chunks of docs (id, flag, text), dealt out by place.

    ``split(texts)`` gives a step's words and how many each text has; ``number(steps)`` gives the numbers of all words of a
    chunk's steps, the bucket edges, and a function that gives blobs (a, b) of the words of a range.  Rows of texts have the
    number of words of each text (a), their numbers (b) and flags (c); rows of words have blobs (a, b) and the chunk in c.
    """
    schema = schema_of(docs)

    def flush(held: list[tuple], no: int, make_number: Callable) -> Iterator[pa.RecordBatch]:
        chunk = (TaskContext.get().partitionId() << 24) + no
        numbers, edges, blobs = make_number([words for _, _, words, _ in held], np.concatenate([np.repeat(f, s) for _, f, _, s in held]))
        at = 0
        names = ["place", "bucket", "ids", "a", "b", "c"]
        for ids, flags, _, sizes in held:
            end = at + int(sizes.sum())
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.record_batch([pa.array([chunk]), pa.array([-1], pa.int32()), listed, *(pa.array([x], pa.binary()) for x in (pack(sizes), pack(numbers[at:end]), pack(flags, "u1")))], names=names)
            at = end
        none = pa.nulls(1, pa.list_(held[0][0].type))
        for k in range(len(edges) - 1):
            if edges[k] < edges[k + 1]:
                a, b = blobs(edges[k], edges[k + 1])
                yield pa.record_batch([pa.array([-1 - k]), pa.array([k], pa.int32()), none, *(pa.array([x], pa.binary()) for x in (a, b, pack(np.array([chunk]), "<i8")))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, no = [], 0, 0
        for batch in batches:
            for at, part in wordhash.steps(batch.column(2)):
                words, sizes = split(part)
                held.append((batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)).to_numpy(zero_copy_only=False).astype(np.uint8), words, sizes))
                total += int(sizes.sum()) + len(part)
                if total >= CHUNK_TOKENS:
                    yield from flush(held, no, lambda steps, flags: number(steps, flags, buckets))
                    held, total, no = [], 0, no + 1
        if held:
            yield from flush(held, no, lambda steps, flags: number(steps, flags, buckets))

    return docs.select("id", "flag", "text").mapInArrow(run, schema).repartition(shuffle_partitions(docs.sparkSession), "place")


def chunk_of(blob: bytes) -> int:
    return int(unpack(blob, "<i8")[0])


def in_order(rows: pa.Table) -> list[dict]:
    """The rows of one chunk's or bucket's answers, by bucket."""
    return sorted(rows.to_pylist(), key=lambda r: r["bucket"])
