"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of learned texts.  A text is normalised (lower case, letters
only), cut into blocks at word ends, and every block is compressed once with each dictionary; the language with the fewest
bytes over all blocks wins (ties: the first by code point).  The margin is the saving against the second best, as a share
of its bytes; ``rejected`` marks margins under ``min_margin`` and texts without letters.

Learning reads a bounded sample: about ``SAMPLE_DOCS`` distinct texts of each language at most, chosen by a hash of the text, and
``DICT_BYTES`` of dictionary each; so a language is learned however often its texts are repeated.  All texts of the sample enter, with equal shares of the dictionary as far as they are
long enough; of longer ones it is a piece at a place chosen by the hash, anywhere in the text.  Scoring reads whole texts of every length.

Null, empty and letterless texts: ``und``, score 0, rejected.  With no learned language every text is ``und``; with one, margins are 1.
Rows with a null language teach nothing.  Repeated rows get equal results; an empty table gives an empty result.  Only the
named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 600
DICT_BYTES = 128 << 10
BLOCK_CHARS = 2000
LEVEL = 6
#: What a short text follows when its bytes alone don't tell the languages apart.
LEAD_BYTES = 512
MIN_MARGIN = 0.002
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")


def normalise(text: str) -> str:
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def blocks(text: str) -> Iterator[str]:
    """Pieces of about BLOCK_CHARS, ended at a space where there is one."""
    at = 0
    while at < len(text):
        end = at + BLOCK_CHARS
        if end < len(text):
            end = text.rfind(" ", at + 1, end) + 1 or end
        yield text[at:end]
        at = end


@dataclass
class LanguageModel:
    dictionaries: dict[str, bytes]
    min_margin: float = MIN_MARGIN
    _ready: list | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "min_margin": self.min_margin, "_ready": None}

    def _compressors(self) -> list:
        import zstandard as zstd

        if self._ready is None:
            self._ready = []
            for lang in sorted(self.dictionaries):
                d = zstd.ZstdCompressionDict(self.dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._ready.append((lang, zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        return self._ready

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected)"""
        if not text or not self.dictionaries or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        parts = [b.encode("utf-8", "replace") for b in blocks(normalise(text))]
        sizes = [(sum(len(c.compress(p)) for p in parts), lang) for lang, c in self._compressors()]
        best, lang = min(sizes)
        if len(parts) == 1 and sum(s <= best * (1 + self.min_margin) for s, _ in sizes) > 1:
            # zstandard stores a short block as it is when little is gained.  Behind a passage of the dictionary, which costs
            # a few bytes, the block is compressed after all; every ending of the text adds its bytes to tell more.
            whole = parts[0]
            starts = range(len(whole)) if len(whole) <= 256 else [0, *(i + 1 for i, c in enumerate(whole) if c == 32)]
            lead = {k: self.dictionaries[k][:LEAD_BYTES] + b" " for _, k in sizes}
            sizes = [(sum(len(c.compress(lead[k] + whole[i:])) - len(c.compress(lead[k])) for i in starts), k) for k, c in self._compressors()]
            best, lang = min(sizes)
        second = min((s for s, k in sizes if k != lang), default=None)
        margin = 1.0 if second is None else (second - best) / max(1, second)
        # A byte saved is eight bits of evidence; half of it counts, since blocks are not independent.
        score = 1.0 / sum(2.0 ** min(0.0, 4.0 * (best - s)) for s, _ in sizes)
        return lang, score, margin, margin < self.min_margin

    def udf(self):
        schema = "lang_pred string, score double, margin double, rejected boolean"
        shared = self

        @F.pandas_udf(schema)
        def predict(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([shared.predict(t) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])

        return predict


def train(docs: DataFrame, text: str = "text", lang: str = "lang", where: Column | None = None, min_margin: float = MIN_MARGIN) -> LanguageModel:
    """Learns from the rows that ``where`` admits and that have a language and a text."""
    rows = docs.where(F.coalesce(where, F.lit(False))) if where is not None else docs
    rows = rows.select(F.col(text).cast("string").alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null")
    rows = rows.withColumn("h", F.xxhash64("t"))
    counts = {r.l: r.n for r in rows.select("l", "h").distinct().groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return LanguageModel({}, min_margin)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, SAMPLE_DOCS / n)))])
    u = F.shiftrightunsigned(F.xxhash64(F.lit("chosen"), "t"), 11) / float(1 << 53)
    # Twice a text's share, since normalising shortens.
    size = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(2 * DICT_BYTES // min(SAMPLE_DOCS, n)))]), F.col("l"))
    place = 1 + F.pmod(F.xxhash64(F.lit("place"), "t"), F.greatest(F.lit(1), F.length("t") - size + 1))
    sample = rows.where(u <= F.element_at(share, F.col("l"))).select("l", F.substr("t", place.cast("int"), size).alias("t"), "h").dropDuplicates(["l", "h"])
    texts: dict[str, dict[str, int]] = {}
    for r in sample.toLocalIterator():
        if (n := normalise(r.t)):
            texts.setdefault(r.l, {})[n] = r.h
    out = {}
    for k, found in texts.items():
        parts = {t: t.encode("utf-8", "replace") for t in found}
        left = DICT_BYTES
        for done, t in enumerate(sorted(parts, key=lambda t: (len(parts[t]), t))):
            parts[t] = parts[t][: max(0, left // (len(parts) - done) - 1)].decode("utf-8", "ignore").encode()
            left -= len(parts[t]) + 1
        out[k] = b" ".join(parts[t] for t in sorted(found, key=lambda t: (found[t], t)))
    return LanguageModel({k: v for k, v in out.items() if len(v) >= 8}, min_margin)


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, margin, rejected"""
    return docs.select(F.col(key), model.udf()(F.col(text)).alias("p")).select(key, "p.*")
