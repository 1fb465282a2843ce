"""Token counts of whole texts with a sentencepiece model; huge texts in overlapping chunks.

A huge text is encoded in chunks that overlap. Two neighbours are spliced at a place in their
overlap where both have a token boundary, where the model can have no piece across (a plain space
between two ASCII letters or digits; no piece of the vocabulary holds the space mark after another
character), and from where on both have the same boundaries. If there is none, the overlap is
widened, in the end to the whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unless_named

_STABLE = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
_LOADED: dict[str, object] = {}


@dataclass(frozen=True)
class TokenCountConfig:
    #: Texts of more characters than this are encoded in chunks.
    chunk_chars: int = 50_000
    overlap_chars: int = 500
    limit: int = 4096


def load(path: str):
    if path not in _LOADED:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if "▁" in p.lstrip("▁")]
        _LOADED[path] = (model, not crossing)
    return _LOADED[path]


def _bounds(model, text: str) -> list[int]:
    """Starts of the tokens, in characters; the library gives them in bytes."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    character = np.concatenate([np.cumsum((raw & 0xC0) != 0x80) - 1, [len(text)]])
    return character[[p.begin for p in model.encode(text, return_type="proto").pieces]].tolist() if text else []


def count_chunked(model, text: str, config: TokenCountConfig) -> int:
    """Tokens of ``text``, as ``model.encode(text)`` would count them."""
    size, total, start = config.chunk_chars, 0, 0
    here, begin = None, 0  # starts of the current chunk's tokens (absolute); where its counted part begins
    while True:
        stop = min(len(text), start + size)
        if here is None:
            here = [start + b for b in _bounds(model, text[start:stop])]
        if stop == len(text):
            return total + sum(b >= begin for b in here)
        overlap = config.overlap_chars
        while True:
            nxt = max(begin, stop - overlap)
            if overlap >= size or nxt <= begin:  # no common boundary: go on with one longer chunk
                size, here = size * 2, None
                break
            end = min(len(text), nxt + size)
            there = [nxt + b for b in _bounds(model, text[nxt:end])]
            mine, other = set(here), set(there)
            stable = [m.start() for m in _STABLE.finditer(text, nxt + 1, stop)]
            at = next((i for i in stable if i in mine and i in other and _agree(here, there, i, stable[-1])), None)
            if at is not None:
                total += sum(begin <= b < at for b in here)
                start, begin, here, size = nxt, at, there, max(config.chunk_chars, end - nxt)
                break
            overlap *= 2


def _agree(here: list[int], there: list[int], at: int, last: int) -> bool:
    """Both have the same boundaries from ``at`` up to ``last``, the last stable place of the overlap.

    Up to there the end of the first chunk changes nothing, as no piece crosses a stable place.
    """
    a = here[bisect_left(here, at) : bisect_right(here, last)]
    return bool(a) and a == there[bisect_left(there, at) : bisect_right(there, last)]


def _count(batches: Iterator[pa.RecordBatch], path: str, config: TokenCountConfig) -> Iterator[pa.RecordBatch]:
    model, safe = load(path)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        counts = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if not safe or len(t) <= config.chunk_chars]
        for k in range(0, len(short), 256):
            some = short[k : k + 256]
            for i, ids in zip(some, model.encode([texts[i] for i in some], num_threads=1)):
                counts[i] = len(ids)
        for i in set(range(len(texts))) - set(short):
            counts[i] = count_chunked(model, texts[i], config)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["key", "n_tokens"])


def count_tokens(docs: DataFrame, model_path: str, keep: list[str] | None = None, config: TokenCountConfig = TokenCountConfig()) -> DataFrame:
    """``keep`` columns of every row (doc_id), then n_bytes (UTF-8), n_tokens, over_limit.

    No begin, end or added special tokens. Null text counts as empty: 0 bytes, 0 tokens. Every row
    gets its own result, repeated ones too; a kept column with the name of a result gives way to it,
    other columns are ignored.
    """
    keep = unless_named(keep or ["doc_id"], ["n_bytes", "n_bytes_", "n_tokens", "over_limit"])
    key = F.struct(*keep, F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes_")).alias("key")
    kind = docs.select(key).schema["key"].dataType.simpleString()
    found = docs.select(key, "text").mapInArrow(lambda it: _count(it, model_path, config), f"key {kind}, n_tokens bigint")
    return found.select(*[F.col("key")[c].alias(c) for c in keep], F.col("key.n_bytes_").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > config.limit).alias("over_limit"))
