"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of labelled texts. A text is lower-cased,
ASCII characters other than letters become blanks, and what is left is compressed with every
dictionary, piece by piece, so that a long text is judged by the dictionary all along and not by
what it said before. The language of the smallest sum wins, and the prediction is rejected when
the runner-up is hardly larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, keyed_text, texts_of, unless_named

_LETTER = regex.compile(r"\p{L}")
#: Bytes of lower-case ASCII letters and of characters beyond ASCII stay; others become blanks.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_TABLE).split())
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageConfig:
    #: Bound of the training sample: for each language, slots x per_slot texts of at most
    #: piece_chars characters each, the ones with the smallest hash of their id. A piece begins at a
    #: place that the hash decides, so it may be any part of its text.
    slots: int = 64
    per_slot: int = 2
    piece_chars: int = 1500
    level: int = 5
    #: A text is compressed in pieces of so many bytes.
    piece_bytes: int = 2048
    #: Rejected when (runner-up - best) / best is below this.
    min_margin: float = 0.002
    #: Most languages; more labels than this are an error, not cut off.
    max_languages: int = 400


def train(rows: DataFrame, config: LanguageConfig = LanguageConfig()) -> list[tuple[str, bytes]]:
    """(lang, dictionary) for each value of ``lang`` in the rows, the most frequent first.

    Null or empty text and null lang are not used.
    """
    h = F.xxhash64("doc_id", "text")
    usable = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().limit(config.max_languages + 1).collect()}
    if len(counts) > config.max_languages:
        raise ValueError(f"more than {config.max_languages} languages")
    places = F.greatest(F.length("text") - config.piece_chars, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("doc_id", "text", F.lit("piece")), places.cast("long")).cast("int") + 1
    piece = F.substr("text", start, F.lit(config.piece_chars))
    # The smallest hash of each slot of each language: partial aggregates, so no task sees a whole language.
    least = usable.select("lang", F.struct(h.alias("h"), piece.alias("piece")).alias("p"), F.pmod(h, F.lit(config.slots * config.per_slot)).alias("slot"))
    pieces = least.groupBy("lang", "slot").agg(F.min("p").alias("p")).orderBy("lang", "slot").collect()
    out: dict[str, list[bytes]] = {}
    for r in pieces:
        out.setdefault(r["lang"], []).append(normal(r["p"]["piece"]))
    return [(lang, b" ".join(out[lang])) for lang in sorted(out, key=lambda k: (-counts[k], k))]


class Sizes:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: list[tuple[str, bytes]], config: LanguageConfig):
        self.step, self.by_lang = config.piece_bytes, []
        for rank, (lang, content) in enumerate(dictionaries):
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=config.level)
            self.by_lang.append((rank, lang, zstandard.ZstdCompressor(level=config.level, dict_data=made, write_checksum=False, write_dict_id=False, write_content_size=False)))

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, score in 0..1 and margin of a text. Equal sizes: the more frequent language."""
        raw = normal(text)
        pieces = [raw[k : k + self.step] for k in range(0, len(raw), self.step)]
        sizes = sorted((sum(len(c.compress(p)) for p in pieces), rank, lang) for rank, lang, c in self.by_lang)
        best = max(1, sizes[0][0])
        if len(sizes) == 1:
            return sizes[0][2], 1.0, 1.0
        margin = (sizes[1][0] - sizes[0][0]) / best
        return sizes[0][2], min(1.0, 0.5 + margin), margin


def _predict(batches: Iterator[pa.RecordBatch], dictionaries, config: LanguageConfig) -> Iterator[pa.RecordBatch]:
    sizes = Sizes(dictionaries.value, config) if dictionaries.value else None
    for batch in batches:
        out = []
        for text in texts_of(batch).to_pylist():
            if sizes is None or not text or not _LETTER.search(text):
                out.append((UNKNOWN, 0.0, True))
                continue
            lang, score, margin = sizes.predict(text)
            out.append((lang, score, margin < config.min_margin))
        lang, score, rejected = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["key", "lang_pred", "score", "rejected"])


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], keep: list[str] | None = None, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """``keep`` columns of every row (doc_id), then lang_pred, score, rejected.

    Only the text decides. Null texts and texts without a letter are ``und``, score 0, rejected; so
    is everything when nothing was learned. Equal sizes: the more frequent language. Texts of any
    length are compressed whole. A kept column with the name of a result gives way to it.
    """
    keep = unless_named(keep or ["doc_id"], ["lang_pred", "score", "rejected"])
    return _judged(docs, dictionaries, keep, config).select("key.*", "lang_pred", "score", "rejected")


def clear_documents(docs: DataFrame, dictionaries: list[tuple[str, bytes]], config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with the columns they came with, whatever their names."""
    return _judged(docs, dictionaries, list(docs.columns), config).where(~F.col("rejected")).select("key.*")


def _judged(docs: DataFrame, dictionaries: list[tuple[str, bytes]], keep: list[str], config: LanguageConfig) -> DataFrame:
    """``key``, a struct of the kept columns, then lang_pred, score, rejected."""
    rows = keyed_text(docs, keep)
    kind = rows.schema["key"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    return rows.mapInArrow(lambda it: _predict(it, shared, config), f"key {kind}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return bucket_of(doc_id, 5) == 0
