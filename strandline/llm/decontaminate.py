"""Benchmark decontamination: windows of benchmark words looked up in the documents.

The windows of all items form a hash set that is broadcast. Each task turns a batch of documents
into one array of word numbers (numbers of benchmark words, 0 for any other word), hashes all
windows at once with a rolling polynomial, and checks every hash that hits word by word.
The set is broadcast only up to ``max_words`` benchmark words; a larger benchmark is scanned in
that many-word blocks, each its own broadcast and pass, and the passes' hits are combined.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, materialize, texts_of, unless_named

#: Bytes of a word after A-Z are lower-cased: digits, a-z and everything beyond ASCII.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class DecontaminateConfig:
    window: int = 13
    #: A document is contaminated from this share of hit words on: hit * share_den >= words * share_num.
    share_num: int = 1
    share_den: int = 20
    #: Most benchmark words in one broadcast. A window takes 72 bytes in a task's memory (its words' numbers,
    #: hash and owners), and every distinct word about 110 more.
    max_words: int = 1_000_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class WindowSet:
    """Windows of some items, by length, as sorted hashes with their words and items."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int):
        self.number: dict[bytes, int] = {}
        self.names: list[str] = []
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)], dtype=np.uint32)
            n = min(window, len(ids))
            if n:
                rows.setdefault(n, []).append(np.lib.stride_tricks.sliding_window_view(ids, n))
                owners.setdefault(n, []).append(np.full(len(ids) - n + 1, -1 if item is None else len(self.names), dtype=np.int32))
                self.names += [] if item is None else [str(item)]
        # By length: hashes in order, their windows, and the owners of each in one list.
        self.by_length = []
        for n in sorted(rows):
            words, window_of = np.unique(np.concatenate(rows[n]), axis=0, return_inverse=True)
            hashes = self._hash(words)
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            owner = np.concatenate(owners[n])
            named = owner >= 0
            pairs = np.unique(place[window_of.reshape(-1)][named] * max(1, len(self.names)) + owner[named])
            starts = np.searchsorted(pairs, np.arange(len(order) + 1) * max(1, len(self.names)))
            self.by_length.append((n, hashes[order], words[order], starts, (pairs % max(1, len(self.names))).astype(np.int32)))

    @staticmethod
    def _hash(words: np.ndarray) -> np.ndarray:
        h = np.zeros(len(words), dtype=np.uint64)
        for k in range(words.shape[1]):
            h = h * _BASE + words[:, k].astype(np.uint64)
        return h

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, np.ndarray, set[str], list[tuple[int, int]]]]:
        """For each text: number of words, mask of hit words, items, hit windows as (word, length)."""
        get = self.number.get
        lists = [[get(w, 0) for w in words_of(t)] for t in texts]
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        starts = np.concatenate([[0], np.cumsum(counts + 1)])  # one 0 ends each text: no window spans two
        flat = np.zeros(int(starts[-1]), dtype=np.uint64)
        for s, ids in zip(starts, lists):
            flat[s : s + len(ids)] = ids
        known = np.concatenate([[0], np.cumsum(flat != 0)])
        edge = np.zeros(len(flat) + 1, dtype=np.int64)
        items: dict[int, set[str]] = {}
        found: dict[int, list[tuple[int, int]]] = {}
        for n, hashes, words, of, owners in self.by_length:
            if len(flat) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            h = np.zeros(len(at), dtype=np.uint64)
            for k in range(n):
                h = h * _BASE + flat[at + k]
            row = np.searchsorted(hashes, h)
            hit = (row < len(hashes)) & (hashes[np.minimum(row, len(hashes) - 1)] == h)
            for p, r, key in zip(at[hit].tolist(), row[hit].tolist(), h[hit].tolist()):
                while r < len(hashes) and hashes[r] == key:  # verify: equal hashes need not be equal windows
                    if np.array_equal(words[r], flat[p : p + n]):
                        edge[p] += 1
                        edge[p + n] -= 1
                        doc = int(np.searchsorted(starts, p, side="right")) - 1
                        items.setdefault(doc, set()).update(self.names[o] for o in owners[of[r] : of[r + 1]])
                        found.setdefault(doc, []).append((p - int(starts[doc]), n))
                        break
                    r += 1
        mask = np.cumsum(edge[:-1]) > 0
        return [(int(c), mask[s : s + c], items.get(i, set()), sorted(found.get(i, ()))) for i, (s, c) in enumerate(zip(starts, counts))]


def _scan(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    windows: WindowSet = shared.value
    for batch in batches:
        found = windows.scan(texts_of(batch).cast(pa.binary()).to_pylist())
        spans = []
        for _, mask, _, _ in found:
            d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
            spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1))])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([x[0] for x in found], pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                pa.array([sorted(x[2]) for x in found], pa.list_(pa.string())),
            ],
            names=["key", "n_words", "spans", "items"],
        )


def benchmark_blocks(benchmark: DataFrame, config: DecontaminateConfig) -> Iterator[WindowSet]:
    """The items in blocks of at most ``max_words`` words (a longer item is a block of its own)."""
    block: list[tuple[object, bytes | None]] = []
    n = 0
    for r in benchmark.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        text = None if r["text"] is None else bytes(r["text"])
        k = len(words_of(text))
        if block and n + k > config.max_words:
            yield WindowSet(block, config.window)
            block, n = [], 0
        block.append((r["item_id"], text))
        n += k
    yield WindowSet(block, config.window)


def contamination(docs: DataFrame, benchmark: DataFrame, config: DecontaminateConfig = DecontaminateConfig(), keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: the columns of ``keep`` (doc_id), then n_words, n_hit, n_items,
    items_sha256, contaminated, hit_spans (word ranges, half-open).

    Words are lower-cased runs of digits, ASCII letters and characters beyond ASCII. A window has
    ``window`` words of an item; an item with fewer words, but some, is one window. Null and empty
    texts have no words, no hits and are clean; an empty benchmark hits nothing. Repeated rows each
    get their row; items with equal ids count once, and windows of items without an id hit but name
    no item. A kept column with the name of a result gives way to it; other columns are ignored.
    """
    keep = unless_named(keep or ["doc_id"], RESULTS)
    return _judged(docs, benchmark, config, keep).select("key.*", *RESULTS)


RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"]


def _judged(docs: DataFrame, benchmark: DataFrame, config: DecontaminateConfig, keep: list[str]) -> DataFrame:
    """``key``, a struct of the kept columns, then RESULTS."""
    spark = docs.sparkSession
    span = "array<struct<start:bigint,stop:bigint>>"
    source = keyed_text(docs, keep)
    blocks = benchmark_blocks(benchmark, config)
    first, second = next(blocks), next(blocks, None)

    def scanned(rows: DataFrame, windows: WindowSet) -> DataFrame:
        shared, kind = spark.sparkContext.broadcast(windows), rows.schema["key"].dataType.simpleString()
        return rows.mapInArrow(lambda it: _scan(it, shared), f"key {kind}, n_words bigint, spans {span}, items array<string>")

    if second is None:
        found = scanned(source, first).select("key", "n_words", "spans", F.array_sort("items").alias("items"))
    else:
        # Rows are numbered once; a pass gives a row's number and hits, and only those are shuffled.
        numbered = materialize(source.withColumn("row", F.monotonically_increasing_id()), "numbered")
        text = F.col("key.text") if "text" in keep else F.col("text")
        narrow = numbered.select(F.struct("row").alias("key"), text.alias("text"))
        hits = scanned(narrow, first).withColumn("n", F.col("n_words"))
        for windows in itertools.chain([second], blocks):
            hits = hits.unionByName(scanned(narrow, windows).where(F.size("spans") > 0).withColumn("n", F.lit(None).cast("long")))
        hits = hits.groupBy(F.col("key.row").alias("row")).agg(F.max("n").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = numbered.join(hits, "row").select("key", "n_words", "spans", "items")
        merged = F.aggregate(
            F.array_sort("spans"),
            F.array().cast(span),
            lambda acc, s: F.when(
                (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] >= s["start"]),
                F.concat(
                    F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                    F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["stop"], s["stop"]).alias("stop"))),
                ),
            ).otherwise(F.concat(acc, F.array(s))),
        )
        found = found.withColumn("spans", merged)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.withColumn("n_hit", n_hit).select(
        "key",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * config.share_den >= F.col("n_words") * config.share_num)).alias("contaminated"),
        F.col("spans").alias("hit_spans"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, config: DecontaminateConfig = DecontaminateConfig()) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns they came with, whatever their names."""
    return _judged(docs, benchmark, config, list(docs.columns)).where(~F.col("contaminated")).select("key.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, config: DecontaminateConfig = DecontaminateConfig()) -> DataFrame:
    """All rows of ``docs`` with their columns; ``text`` is without the words inside benchmark windows.

    Other texts come out as they went in, null ones too.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([remove_spans(t, [(s["start"], s["stop"]) for s in of]) for t, of in zip(texts, spans)], dtype=object)

    judged = _judged(docs, benchmark, config, list(docs.columns))
    clean = F.when(F.size("hit_spans") > 0, cut("key.text", "hit_spans")).otherwise(F.col("key.text"))
    return judged.select(F.col("key").withField("text", clean).alias("key")).select("key.*")


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the hit words, from the first word's start to the last one's end."""
    if text is None or not spans:
        return text
    raw = text.encode()
    flat, at, places = raw.translate(_TABLE), 0, []
    for w in flat.split():
        at = flat.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for start, stop in spans:
        out.append(raw[last : places[start][0]])
        last = places[stop - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
