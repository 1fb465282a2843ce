"""Vectors as short codes: one codebook for each part of a vector, nearest entries by partial distances.

A part is compared with its codebook's entries dimension by dimension, those along which the entries
differ most first. A pair of a part and an entry is dropped as soon as its sum of squares so far exceeds
the best complete distance that the part has found, so most pairs see few dimensions. Distances are
integers, so the codes are those of a full search, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import floored, matrix, one_length, usable


@dataclass(frozen=True)
class CodeConfig:
    #: A component x becomes the integer floor(scale * x).
    scale: int = 256
    parts: int = 16
    #: Entries of a codebook: the parts of the vectors with the smallest ids to begin with.
    entries: int = 64
    rounds: int = 2
    #: Entries that are compared before the best distances are looked at again.
    block: int = 16
    #: Labels whose summed errors may be broadcast; beyond that they are joined by a shuffle.
    broadcast_labels: int = 100_000

    def __post_init__(self):
        if not 0 < self.entries <= 256:
            raise ValueError("an entry's index is two hex digits")


def nearest(x: np.ndarray, book: np.ndarray, block: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of ``book`` for every row of ``x``; ties to the lower index."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    # One complete distance to begin with: of the entry nearest along the first dimension.
    by_first = np.argsort(book[:, 0], kind="stable")
    at = np.searchsorted(book[by_first, 0], x[:, 0]).clip(1, max(1, len(book) - 1)) if len(book) > 1 else np.zeros(len(x), dtype=np.int64)
    if len(book) > 1:
        low, high = book[by_first[at - 1], 0], book[by_first[at], 0]
        at = at - (x[:, 0] - low <= high - x[:, 0])
    index = by_first[at]
    best = ((x - book[index]) ** 2).sum(axis=1)
    for first in range(0, len(book), block):
        some = book[first : first + block]
        gone = (x[:, :1] - some[:, 0]) ** 2
        row, entry = np.nonzero(gone <= best[:, None])
        so_far = gone[row, entry]
        for k in range(1, x.shape[1]):
            so_far = so_far + (x[row, k] - some[entry, k]) ** 2
            live = so_far <= best[row]
            row, entry, so_far = row[live], entry[live], so_far[live]
        if not len(row):
            continue
        # Rows stand in order, and a row's entries by index: the first of the least ones counts.
        start = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(so_far, start)
        hit = np.flatnonzero(so_far == np.repeat(least, np.diff(start, append=len(row))))
        rows, where = np.unique(row[hit], return_index=True)
        found = entry[hit[where]] + first
        better = (least < best[rows]) | (found < index[rows])  # no survivor is further off than the best
        index[rows[better]], best[rows[better]] = found[better], least[better]
    return index, best


def _assign(x: np.ndarray, books: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and distances of every row's parts, (rows, parts) each."""
    parts, width = len(books), books.shape[2]
    found = [nearest(x[:, p * width : (p + 1) * width], books[p], block) for p in range(parts)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _recentred(rows: DataFrame, books: np.ndarray, block: int) -> np.ndarray:
    """The codebooks with every entry replaced by the floored mean of its parts.

    A task adds up its own parts, one row for each entry that it uses; the driver gets the sums alone.
    """
    parts, entries, width = books.shape
    names = [f"s{i}" for i in range(width)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, dtype=np.int64), np.zeros((parts * entries, width), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                x = matrix(batch.column(0).slice(at, 2000), parts * width)
                cell = _assign(x, books, block)[0] + np.arange(parts) * entries
                np.add.at(count, cell.reshape(-1), 1)
                np.add.at(total, cell.reshape(-1), x.reshape(-1, width))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *(pa.array(total[used, i]) for i in range(width))], names=["cell", "count", *names])

    sent = rows.select("x").mapInArrow(task, "cell bigint, count bigint, " + ", ".join(f"{c} bigint" for c in names))
    new = books.copy().reshape(-1, width)
    for cell, count, *total in sent.groupBy("cell").agg(F.sum("count"), *(F.sum(c) for c in names)).collect():
        new[cell] = np.array(total) // count  # numpy's integer division floors
    return new.reshape(books.shape)


def _rows(vectors: DataFrame, config: CodeConfig, column: str) -> DataFrame:
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col(column).cast("array<double>").alias("v")).where(usable(F.col("v")))
    return x.select("vec_id", "label", floored(F.col("v"), config.scale).alias("x"))


def train(vectors: DataFrame, config: CodeConfig = CodeConfig(), column: str = "embedding") -> np.ndarray | None:
    """The codebooks of all usable vectors: an array (part, entry, position); None where there are none.

    The first entries are the parts of the vectors with the smallest ids (equal ids by their components,
    null ids last); fewer vectors than entries make smaller codebooks. Vectors of several lengths, of a
    length that has no ``config.parts`` equal parts, or with components of more than 28 bits are an error.
    """
    rows = _rows(vectors, config, column)
    n, d = one_length(rows, "x")
    if not n:
        return None
    if d % config.parts:
        raise ValueError(f"{d} components have no {config.parts} equal parts")
    if rows.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0] >= 2**28:
        raise ValueError("components of more than 28 bits: squared distances might not fit a long")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(config.entries).select("x").collect()
    books = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), config.parts, -1).transpose(1, 0, 2)
    for _ in range(config.rounds):
        books = _recentred(rows, books, config.block)
    return books


def digest(books: np.ndarray | None) -> str:
    """Lowercase hex of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray | None, config: CodeConfig = CodeConfig(), column: str = "embedding") -> DataFrame:
    """One row per usable row of ``vectors`` (vec_id, label, embedding): vec_id, label, code, error.

    Null and empty vectors and those with null or non-finite components give no rows; repeated rows and
    null ids stay as they are; other columns are ignored; without codebooks there are no rows.
    """
    rows = _rows(vectors, config, column)
    kind = rows.schema["label"].dataType.simpleString()
    out = f"vec_id bigint, label {kind}, code string, error bigint"
    if books is None:
        return rows.sparkSession.createDataFrame([], out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                index, far = _assign(matrix(part.column(2), books.shape[0] * books.shape[2]), books, config.block)
                text = [row.tobytes().hex() for row in index.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(far.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(task, out)


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` (with a column ``code``) and ``decoded``: the vector of integers that a code stands for."""
    entries = F.array(*(F.array(*(F.array(*(F.lit(int(c)) for c in entry)) for entry in book)) for book in books))
    digits = F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.struct(p.alias("p"), F.conv(F.substring(F.col("code"), p * 2 + 1, F.lit(2)), 16, 10).cast("int").alias("i")))
    return codes.withColumn("decoded", F.flatten(F.transform(digits, lambda s: entries[s["p"]][s["i"]])))


def coded(vectors: DataFrame, config: CodeConfig = CodeConfig(), column: str = "embedding") -> DataFrame:
    """Training, codes and errors of one table: vec_id, code, error, label_error, codebooks_sha256.

    ``label_error`` is the error summed over the rows with the same label, nulls together. It is summed
    before it is joined back, so a label that very many rows have meets in no task.
    """
    books = train(vectors, config, column)
    rows = materialize(encode(vectors, books, config, column), "codes")
    by_label = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    by_label = materialize(by_label, "code-labels")
    if by_label.count() <= config.broadcast_labels:
        by_label = F.broadcast(by_label)
    found = rows.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
