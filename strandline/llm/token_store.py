"""Token ids of a corpus in shard files, each a wavelet matrix.

A shard file holds the ids of consecutive documents (ascending doc_id) as one bit-plane per bit of
the largest id, with sampled ranks, plus the documents' ids and ends. From one file it answers:
the token at a place, how often a token occurs before a place, where its k-th occurrence is, and
all tokens of a document. Sections are compressed one by one, so a reader inflates what it needs.

Executors have no common file system but what Spark writes, so a shard file is the ``payload`` of
one row of a Parquet table in the shared folder.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MAGIC = b"WMX1"
#: Bits of a plane per sampled rank.
BLOCK = 512
#: Places that are parted at once, so that their numbers stay in a core's cache.
NEAR = 1 << 16


@dataclass(frozen=True)
class TokenStoreConfig:
    #: Text bytes of a part, which one task encodes.
    part_bytes: int = 16_000_000
    end_id: int = 2
    #: A shard is closed once it has so many ids (one longer document is a shard of its own).
    shard_tokens: int = 1 << 20
    #: Bound of a worker's memory of encoded words; it is emptied when full.
    cached_words: int = 800_000


class WaveletMatrix:
    """Bit-planes of a sequence, most significant bit first, each level stably split by its bit."""

    def __init__(self, size: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.size, self.planes, self.zeros, self.ranks = size, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        then = np.empty_like(now)
        planes, zeros, ranks = [], [], []
        for k in range(bits - 1, -1, -1):
            b = now & now.dtype.type(1 << k) != 0
            packed = np.packbits(b, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), dtype=np.uint8)])
            planes.append(packed)
            ranks.append(cls._sampled(packed))
            zeros.append(len(now) - int(ranks[-1][-1]))
            z, o = 0, zeros[-1]
            for at in range(0, len(now), NEAR):
                some = b[at : at + NEAR]
                one, zero = np.flatnonzero(some), np.flatnonzero(np.logical_not(some, out=some))
                # "clip" lets numpy write into the given array at once; no place is out of range.
                now[at : at + NEAR].take(zero, out=then[z : z + len(zero)], mode="clip")
                now[at : at + NEAR].take(one, out=then[o : o + len(one)], mode="clip")
                z, o = z + len(zero), o + len(one)
            now, then = then, now
        return cls(len(ids), planes, zeros, ranks)

    @staticmethod
    def _sampled(packed: np.ndarray) -> np.ndarray:
        per = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(per)]).astype(np.uint32)

    def _rank1(self, level: int, at: int) -> int:
        """Ones among the first ``at`` bits of a plane."""
        block, plane = at // BLOCK, self.planes[level]
        first, stop = block * BLOCK // 8, at // 8
        ones = int(self.ranks[level][block]) + int(np.bitwise_count(plane[first:stop]).sum())
        return ones + (int(plane[stop] & ((1 << at % 8) - 1)).bit_count() if at % 8 else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value in a plane."""
        ranks = self.ranks[level].astype(np.int64)
        if not bit:
            ranks = np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(ranks[block])])

    def _bits(self, token: int) -> list[int]:
        return [token >> k & 1 for k in range(len(self.planes) - 1, -1, -1)]

    def access(self, at: int) -> int:
        token = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][at // 8]) >> at % 8 & 1
            ones = self._rank1(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, stop: int) -> tuple[int, int]:
        """Where the occurrences before ``stop`` lie below the last plane."""
        if token < 0 or token >> len(self.planes):
            return 0, 0
        a, b = 0, stop
        for level, bit in enumerate(self._bits(token)):
            x, y = self._rank1(level, a), self._rank1(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if bit else (a - x, b - y)
        return a, b

    def count(self, token: int, stop: int | None = None) -> int:
        """Occurrences of ``token`` before ``stop``."""
        a, b = self._range(token, self.size if stop is None else stop)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``token``."""
        a, b = self._range(token, self.size)
        if not 0 <= k < b - a:
            raise IndexError(f"token {token} occurs {b - a} times")
        at = a + k
        for level, bit in reversed(list(enumerate(self._bits(token)))):
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """The whole sequence."""
        now = np.zeros(self.size, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        up = np.empty_like(now)
        for k, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            z, o = 0, zeros
            for at in range(0, self.size, NEAR):
                b = np.unpackbits(plane[at // 8 : (at + NEAR) // 8], count=min(NEAR, self.size - at), bitorder="little").view(bool)
                one, zero = np.flatnonzero(b), np.flatnonzero(np.logical_not(b, out=b))
                up[at : at + NEAR][zero] = now[z : z + len(zero)]
                up[at : at + NEAR][one] = now[o : o + len(one)] | now.dtype.type(1 << k)
                z, o = z + len(zero), o + len(one)
            now, up = up, now
        return now


def write_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One shard file: magic, length of the JSON header, header, compressed sections."""
    matrix = WaveletMatrix.build(ids)
    pack = zstandard.ZstdCompressor(level=1).compress
    ends = np.cumsum(np.array(lengths, dtype=np.int64))
    sections = [pack(np.array([d or 0 for d in doc_ids], dtype=np.int64).tobytes()), pack(np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes()), pack(ends.tobytes())]
    for plane, rank in zip(matrix.planes, matrix.ranks):
        sections += [pack(plane.tobytes()), pack(rank.tobytes())]
    header = json.dumps({"docs": len(doc_ids), "tokens": int(matrix.size), "zeros": matrix.zeros, "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections])


class Shard:
    """A shard file opened for reading."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard file")
        n = struct.unpack_from("<I", data, 4)[0]
        self.header = json.loads(data[8 : 8 + n])
        at, parts = 8 + n, []
        for size in self.header["sections"]:
            parts.append(data[at : at + size])
            at += size
        if at != len(data):
            raise ValueError("a shard file of another length than its header says")
        inflate = zstandard.ZstdDecompressor().decompress
        nulls = np.frombuffer(inflate(parts[1]), np.uint8)
        self.doc_ids = [None if x else int(d) for d, x in zip(np.frombuffer(inflate(parts[0]), np.int64), nulls)]
        self.ends = np.frombuffer(inflate(parts[2]), np.int64)
        self.matrix = WaveletMatrix(self.header["tokens"], [np.frombuffer(inflate(p), np.uint8) for p in parts[3::2]], self.header["zeros"], [np.frombuffer(inflate(p), np.uint32) for p in parts[4::2]])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start within the shard and ids of every document, in order."""
        ids, start = self.matrix.decode(), 0
        for doc, end in zip(self.doc_ids, self.ends.tolist()):
            yield doc, start, ids[start:end]
            start = end


class _Loose(Exception):
    """The text must be encoded as a whole."""


class _Cache(dict):
    """Encoded ids (little-endian 32-bit) by string, filled by ``make``; emptied when full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        made = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = made
        return made


def _byte_letters() -> str:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 characters for
    themselves, the other bytes in order for the characters from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(other)) for b in range(256))


class Encoder:
    """Ids as the library gives them for the whole text, encoding each distinct word once.

    The tokenizer splits a text into parts before it merges: a plain space between two characters
    that are not white space always begins one. So texts are cut there, a cut piece is split into
    parts by the tokenizer's own pattern, and the library's model merges each part. A single line end
    between two such characters begins a part as well, so texts are cut there, too; a piece after one
    begins with it, any other stands after a space. Texts with pieces that begin or end in other white
    space (runs of it), and texts that hold an added token, go to the library whole.
    """

    #: Beyond this the pattern's letter classes may differ between libraries.
    KNOWN = "ɏ"
    LETTERS = _byte_letters()
    SPACE = LETTERS[0x20]

    def __init__(self, path: str, config: TokenStoreConfig):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.parts = regex.compile(public_tokenizers.PATTERN)
        self.merge = self.library.model.tokenize
        self.by_part = _Cache(self._part, config.cached_words // 4)
        self.by_piece = _Cache(self._piece, config.cached_words)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if part[0] == " " and part[1:].isalpha():
            return self.by_piece[part[1:]]
        return self._merged(charmap_decode(part.encode(), "strict", self.LETTERS)[0])

    def _merged(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.merge(letters)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha():  # one part
            if piece.isascii():
                return self._merged(self.SPACE + piece)
            if max(piece) <= self.KNOWN:
                return self._merged(self.SPACE + charmap_decode(piece.encode(), "strict", self.LETTERS)[0])
        line = piece[:1] == "\n"
        rest = piece[line:]
        if not rest or rest[0].isspace() or rest[-1].isspace():
            raise _Loose
        given = piece if line else " " + piece
        if not piece.isascii() and max(piece) > self.KNOWN:
            return self.whole(given)
        stop = rest[-1] if rest[-1] in ".,;:!?" else ""
        word = rest[:-1] if stop else rest
        if word.isalpha():
            return (self.by_part["\n"] + self.by_part[word] if line else self.by_piece[word]) + (self.by_part[stop] if stop else b"")
        return b"".join(map(self.by_part.__getitem__, self.parts.findall(given)))

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return self.whole(text)
        if " \n" in text:
            return self.whole(text)
        first, *rest = text.split(" ") if "\n\n" in text else text.replace("\n", " \n").split(" ")
        if not rest:
            return self.whole(text)
        if not first or first[-1].isspace():
            return self.whole(text)
        try:
            return (self.by_part[first] if first.isascii() and first.isalpha() else self.whole(first)) + b"".join(map(self.by_piece.__getitem__, rest))
        except _Loose:
            return self.whole(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, config: TokenStoreConfig) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, config)
    return _ENCODERS[path]


def _shards(batches: Iterator[pa.RecordBatch], path: str, config: TokenStoreConfig) -> Iterator[pa.RecordBatch]:
    encode = encoder(path, config).encode
    end = np.array([config.end_id], dtype="<u4").tobytes()
    part, seq = TaskContext.get().partitionId(), 0
    docs: list[int | None] = []
    lengths: list[int] = []
    encoded: list[bytes] = []
    n = 0

    def flush() -> pa.RecordBatch:
        data = write_shard(docs, lengths, np.frombuffer(b"".join(encoded), "<u4"))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "n_tokens", "payload"])

    for batch in batches:
        texts = batch.column(1)
        for i, doc in enumerate(batch.column(0).to_pylist()):
            ids = encode(texts[i].as_py() or "") + end
            docs.append(doc)
            encoded.append(ids)
            lengths.append(len(ids) // 4)
            n += len(ids) // 4
            if n >= config.shard_tokens:
                yield flush()
                docs, lengths, encoded, n, seq = [], [], [], 0, seq + 1
    if docs:
        yield flush()


def write(docs: DataFrame, path: str, config: TokenStoreConfig = TokenStoreConfig()) -> DataFrame:
    """Encode all rows in ascending doc_id order; the table of shard files, as written.

    Columns: part, seq (shards in order), n_tokens, payload (the file). Null text is empty, and each
    document ends with ``end_id``. Null ids come first, repeated ids stand together ordered by
    text. An empty table gives no shards. Other columns are ignored.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # Ids decide, then how texts begin, so that rows without an id are spread as well.
    begin = F.substring("text", 1, 8)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(max(1, -(-total // config.part_bytes)), "doc_id", begin).sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(lambda it: _shards(it, path, config), "part bigint, seq bigint, n_tokens bigint, payload binary"), "token-shards")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows = [(d, s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, s, ids in Shard(batch.column(2)[i].as_py()).documents()]
            d, s, k, c = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0)[i].as_py()] * len(rows), pa.int64()), pa.array([batch.column(1)[i].as_py()] * len(rows), pa.int64()), *(pa.array(x, pa.int64()) for x in (d, s, k, c))],
                names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
            )


def read(shards: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # Running totals in two steps: over the parts (a row each), then over the shards of a part.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    parts = parts.select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = shards.select("part", "seq", within.alias("within")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("within")).alias("base"))
    rows = shards.select("part", "seq", "payload").mapInArrow(_documents, "part bigint, seq bigint, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
