"""BPE encoding and decoding through a table of distinct words.

A text is split at special tokens, normalised and split into words as the vocabulary file says, over whole steps of texts at
once.  The words of a chunk of texts become numbers of its distinct words (see ``chunks``); these are dealt out by hash, so
each distinct word of the corpus is encoded once, by the one task that has its bucket.  Its ids go back to the chunks and are
joined to the words' positions.  Decoding joins ids to the vocabulary's id-to-piece table (bounded: one entry for each id) and
joins the pieces by a space, which is what the file prescribes by having no decoder; the digests' decoded text is made so.

A task holds the distinct words of its buckets, a share that falls with the number of shuffle partitions, and one chunk.  The
vocabulary is read on the driver and sent to executors; what a lost executor had is computed again from the texts.

Null text counts as empty: no ids, empty decoded text.  Texts are never cut, whatever their length.  Rows with equal texts get equal
results, in repeated rows too; an empty table gives an empty result.  Only key and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks, wordhash

#: The split that whole steps of texts are given; files with another one are split text by text.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that unicodedata and the tokenizers library surely normalise alike; other texts go through the library.
_PLAIN = r"[\x00-ɏ‐-‧‰-›₠-₿™]"
#: Words that go to the library at once.
_BATCH_WORDS = 2000
_SPACE, _LETTER, _NUMBER, _SIGN, _OTHER = range(5)


def id_to_piece(parsed: dict) -> dict[int, str]:
    return {i: p for p, i in parsed["model"]["vocab"].items()} | {t["id"]: t["content"] for t in parsed["added_tokens"]}


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each character; _OTHER where a text with it must go through the library."""
    kind, lower = np.full(0x10FFFF + 1, _OTHER, dtype=np.uint8), np.zeros(0x2200, dtype=np.uint32)
    plain, kinds = regex.compile(_PLAIN), [(regex.compile(p), k) for p, k in ((r"\p{White_Space}", _SPACE), (r"\p{L}", _LETTER), (r"\p{N}", _NUMBER))]
    for i in range(len(lower)):
        low = chr(i).lower()
        if plain.match(chr(i)) and len(low) == 1 and unicodedata.normalize("NFC", chr(i)) == chr(i):
            kind[i] = next((k for p, k in kinds if p.match(low)), _SIGN)
            lower[i] = ord(low)
    return kind, lower


class Splitter:
    """Texts to words, as a vocabulary file says.  A special token is a word of its own."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        self.normaliser = Tokenizer.from_str(json.dumps(parsed | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None, "truncation": None, "padding": None})).normalizer
        pattern = next(p for p in parsed["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        # \s of the file's regex dialect is Unicode's White_Space.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.whole = pattern == _SPLIT and [n["type"] for n in parsed["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.specials = [t["content"] for t in parsed["added_tokens"]]
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")")

    def one(self, text: str) -> list[str]:
        """The words of one text."""
        out: list[str] = []
        for part in self.at_special.split(text):
            out += [part] if part in self.specials else self.split(self.normaliser.normalize_str(part))
        return out

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All words, one text after the other, and how many each text has."""
        texts = texts.cast(pa.large_string()).fill_null("")
        first = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[first[0] : first[-1]]
        first = first - first[0]
        kinds, lower = _characters()
        if ascii := not len(data) or int(data.max()) < 128:
            cp = data
        else:
            cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
            first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[first]
        kind = kinds[cp]
        # Texts that need the library or may hold special tokens.
        odd = np.zeros(len(texts), dtype=bool) if self.whole else np.ones(len(texts), dtype=bool)
        odd[np.searchsorted(first, np.flatnonzero(kind == _OTHER), side="right") - 1] = True
        for lead in {s[0] for s in self.specials}:
            odd[np.searchsorted(first, np.flatnonzero(cp == ord(lead)), side="right") - 1] |= True
        if odd.any():
            maybe = np.flatnonzero(odd)
            for i in maybe:
                if kind[first[i] : first[i + 1]].max(initial=0) != _OTHER and self.whole:
                    odd[i] = self.at_special.search(texts[int(i)].as_py()) is not None
                if odd[i]:
                    kind[first[i] : first[i + 1]] = _SPACE
        words, sizes = self._whole(cp, kind, first, lower, ascii)
        if not odd.any():
            return words, sizes
        parts, at = [], 0
        ends = np.concatenate(([0], np.cumsum(sizes)))
        for i in np.flatnonzero(odd):
            own = self.one(texts[int(i)].as_py())
            parts += [words.slice(at, ends[i] - at), pa.array(own, pa.large_string())]
            at, sizes[i] = ends[i], len(own)
        return pa.concat_arrays([*parts, words.slice(at)]), sizes

    @staticmethod
    def _whole(cp: np.ndarray, kind: np.ndarray, first: np.ndarray, lower: np.ndarray, ascii: bool) -> tuple[pa.Array, np.ndarray]:
        """Words of plain texts: runs of letters, single numbers, runs of signs, and an apostrophe with certain endings."""
        before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))[: len(kind)]
        before[first[:-1][first[:-1] < len(kind)]] = _SPACE
        starts = (kind != _SPACE) & ((kind != before) | (kind == _NUMBER))
        at = np.flatnonzero(starts & (cp == 39))
        if len(at):
            end = first[np.searchsorted(first, at, side="right")]
            padded = np.concatenate((lower[np.minimum(cp, len(lower) - 1)], np.zeros(3, np.uint32))) if len(at) * 50 > len(cp) else None
            near = [np.where(at + k < end, padded[at + k] if padded is not None else lower[np.minimum(cp[np.minimum(at + k, len(cp) - 1)], len(lower) - 1)], 0) for k in (1, 2)]
            short = np.isin(near[0], [ord(c) for c in "stmd"])
            long = np.zeros(len(at), dtype=bool)
            for a, b in ("re", "ve", "ll"):
                long |= (near[0] == ord(a)) & (near[1] == ord(b))
            starts[at[short | long] + 1] = False
            after = np.concatenate((at[short] + 2, at[long] + 3))
            inside = after < np.concatenate((end[short], end[long]))
            after = after[inside]
            starts[after[kind[after] == _LETTER]] = True
        sizes = np.diff(np.searchsorted(np.flatnonzero(starts), first))
        kept = kind != _SPACE
        low = lower[cp[kept]]
        begin = np.flatnonzero(starts[kept])
        if ascii:
            data = low.astype(np.uint8).tobytes()
            offsets = np.append(begin, len(low))
        else:
            data = low.tobytes().decode("utf-32-le").encode()
            offsets = np.concatenate(([0], np.cumsum(1 + (low >= 0x80) + (low >= 0x800).astype(np.int64))))[np.append(begin, len(low))]
        return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)), sizes


def _coded(texts: pa.Array, splitter: Splitter) -> tuple[pa.DictionaryArray, np.ndarray]:
    """A step's words as numbers of its distinct ones: four bytes for each word while a chunk is gathered."""
    words, sizes = splitter(texts)
    return words.dictionary_encode(), sizes


def _number(steps: list[pa.DictionaryArray], flags: np.ndarray, buckets: int) -> tuple[np.ndarray, list[int], Callable]:
    """The distinct words of a chunk by hash, and each word's number among them."""
    coded = pa.concat_arrays([s.dictionary for s in steps]).dictionary_encode()
    words = coded.dictionary
    at = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    h = wordhash.of_slices(np.frombuffer(words.buffers()[2], dtype=np.uint8), at[:-1], at[1:]) if len(words) else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    words = words.take(pa.array(order))
    at = np.frombuffer(words.buffers()[1], dtype=np.int64)[: len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = words.buffers()[2] if len(words) else b""

    def blobs(i: int, j: int) -> tuple[bytes, bytes]:
        return chunks.pack(np.diff(at[i : j + 1])), chunks.squeeze(memoryview(data)[at[i] : at[j]])

    own = np.split(rank[coded.indices.to_numpy()], np.cumsum([len(s.dictionary) for s in steps])[:-1])
    return np.concatenate([r[s.indices.to_numpy()] for r, s in zip(own, steps, strict=True)]), chunks.bucket_edges(h[order], buckets), blobs


class Encoder:
    """Distinct words to ids, each word once."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer, pre_tokenizers

        parsed = json.loads(spec)
        self.specials = {t["content"]: array("I", [t["id"]]).tobytes() for t in parsed["added_tokens"]}
        bare = json.dumps(parsed | {"normalizer": None, "pre_tokenizer": None, "added_tokens": [], "truncation": None, "padding": None})
        self.model = Tokenizer.from_str(bare)
        # Words hold no white space, so many go to the library as one text with a line for each.
        lines = pre_tokenizers.Split("\n", "removed")
        self.model.pre_tokenizer = pre_tokenizers.Sequence([lines, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.table: dict[str, bytes] = dict(self.specials)

    def __call__(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes of 32-bit numbers."""
        table = self.table
        new = list({w for w in words if w not in table})
        for at in range(0, len(new), _BATCH_WORDS):
            part = new[at : at + _BATCH_WORDS]
            found = self.model.encode("\n".join(part), add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(found.word_ids, minlength=len(part)))).tolist()
            for w, i, j in zip(part, [0, *ends], ends):  # noqa: B905
                table[w] = ids[i:j]
        return [table[w] for w in words]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(maxsize=2)
def _splitter(spec: str) -> Splitter:
    return Splitter(spec)


@lru_cache(maxsize=2)
def _pieces(spec: str) -> tuple[pa.Array, pa.Array]:
    """By id: the id as text and its piece, each with a space behind it; null for ids that the vocabulary lacks."""
    found = id_to_piece(json.loads(spec))
    ids = range(max(found) + 1)
    return pa.array([f"{i} " for i in ids], pa.large_string()), pa.array([found[i] + " " if i in found else None for i in ids], pa.large_string())


def _joined(table: pa.Array, ids: pa.Array, ends: np.ndarray) -> list[bytes]:
    """For each run of ids (from one end to the next) the table's entries, joined by a space."""
    found = table.take(ids)
    at = np.frombuffer(found.buffers()[1], dtype=np.int64)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
    data = memoryview(found.buffers()[2] or b"")
    cut = at[ends].tolist()
    return [data[i : j - 1] if j > i else b"" for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _encode(df: DataFrame, vocabulary: str, key: str, text: str, schema: str, make: Callable) -> DataFrame:
    """make(vocabulary, ids of rows, token ids, where each row's begin) over all rows of df."""
    spec = df.sparkSession.sparkContext.broadcast(vocabulary)  # one file of a few MB, whatever the data
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.lit(False).alias("flag"), F.col(text).cast("string").alias("text"))
    dealt = chunks.deal(rows, lambda texts: _coded(texts, _splitter(spec.value)), _number, chunks.buckets_of(df))

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            b = b.filter(pc.less(b.column(0), 0))  # rows of texts are not made Python objects
            for bucket, lens, body, chunk in zip(*(b.column(i).to_pylist() for i in (1, 3, 4, 5)), strict=True):
                encoder = encoder or Encoder(spec.value)
                data = chunks.expand(body)
                offsets = _ends(chunks.unpack(lens))
                ids = encoder(pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)).to_pylist())
                counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                yield pa.record_batch([pa.array([chunks.chunk_of(chunk)]), pa.array([bucket], pa.int32()), *(pa.array([chunks.pack(x)], pa.binary()) for x in (counts, np.frombuffer(b"".join(ids), "<i4")))], names=["place", "bucket", "counts", "ids"])

    answers = dealt.mapInArrow(encode_words, "place long, bucket int, counts binary, ids binary")

    def join_back(texts: pa.Table, words: pa.Table) -> pa.Table:
        texts = texts.filter(pc.greater_equal(texts["place"], 0))
        found = chunks.in_order(words)
        none = np.zeros(0, np.int32)
        ids = np.concatenate([none, *(chunks.unpack(r["ids"]) for r in found)])
        lists = pa.LargeListArray.from_arrays(pa.array(_ends(np.concatenate([none, *(chunks.unpack(r["counts"]) for r in found)]))), pa.array(ids))
        out = []
        for r in range(texts.num_rows):
            got = lists.take(pa.array(chunks.unpack(texts["b"][r].as_py())))
            flat = got.flatten()
            at = np.concatenate(([0], np.cumsum(pc.list_value_length(got).to_numpy())))
            out.append(make(spec.value, texts["ids"][r].values, flat, at[_ends(chunks.unpack(texts["a"][r].as_py()))]))
        return pa.concat_tables(out) if out else make(spec.value, pa.array([], texts["ids"].type.value_type), pa.array([], pa.int32()), np.zeros(1, np.int64))

    return dealt.groupBy("place").cogroup(answers.groupBy("place")).applyInArrow(join_back, f"key {kind}, {schema}").withColumnRenamed("key", key)


def _listed(flat: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.cast(pa.int32()))


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int) of every row; vocabulary: the text of a tokenizers file."""

    def make(spec: str, keys: pa.Array, flat: pa.Array, ends: np.ndarray) -> pa.Table:
        return pa.table({"key": keys, "ids": _listed(flat, ends)})

    return _encode(df, vocabulary, key, text, "ids array<int>", make)


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and decoded text of every row; null ids decode to null.  Ids that the vocabulary lacks are left out, as the library does."""
    spec = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            pieces = _pieces(spec.value)[1]
            flat = lists.flatten()
            has = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces)))
            flat = pc.if_else(has, flat, None)
            texts = [bytes(x).decode() for x in _joined(pieces, flat, _ends(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))]
            yield pa.record_batch([b.column(0), pc.if_else(lists.is_valid(), pa.array(texts, pa.string()), None)], names=["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(ids).cast("array<int>")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def encode_digests(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The ids that encode() gives, and what they decode to by the id-to-piece table, as digests: key, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for."""

    def make(spec: str, keys: pa.Array, flat: pa.Array, ends: np.ndarray) -> pa.Table:
        digests = [pa.array([hashlib.sha256(x).hexdigest() for x in _joined(t, flat, ends)], pa.string()) for t in _pieces(spec)]
        out = {"key": keys, "n_tokens": pa.array(np.diff(ends)), "ids_sha256": digests[0], "decoded_sha256": digests[1]}
        return pa.table(out | {"ids": _listed(flat, ends)} if with_ids else out)

    return _encode(df, vocabulary, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, make)
