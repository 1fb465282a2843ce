"""What the operators on stored vectors share: the usable rows, their length and sums over their batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """A vector that is not null or empty and holds finite numbers only."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def floored(v: Column, scale: int, offset: int = 0) -> Column:
    """floor(scale * component) + offset of every component, as longs; all floors go down."""
    return F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c) + F.lit(offset).cast("long"))


def one_length(df: DataFrame, column: str) -> tuple[int, int]:
    """(rows, length of their vectors); vectors of several lengths are an error."""
    n, low, high = df.agg(F.count("*"), F.min(F.size(column)), F.max(F.size(column))).first()
    if n and low != high:
        raise ValueError(f"vectors of one length are asked for; here are {low} to {high} components")
    return n, low or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(df: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray], columns: int, kind: str = "double") -> np.ndarray:
    """Sum over all rows of ``of(matrix of a batch)``, itself a matrix of ``columns`` columns.

    A task adds up its batches and sends one row for each row of the sum; Spark adds those up, and the
    driver gets the sum alone. ``df`` has one column, the vectors.
    """
    names = [f"c{i}" for i in range(columns)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(matrix(batch.column(0), width))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *(pa.array(total[:, i]) for i in range(columns))], names=["row", *names])

    parts = df.mapInArrow(task, "row bigint, " + ", ".join(f"{c} {kind}" for c in names))
    rows = sorted(parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in names)).collect())
    return np.array([r[1:] for r in rows], dtype=np.int64 if kind == "bigint" else np.float64)
