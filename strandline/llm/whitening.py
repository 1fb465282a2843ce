"""Whitening of embeddings with the leading eigenvectors of their covariance, found by LOBPCG.

The covariance matrix itself is never made. Each iteration multiplies it with a block of directions in
one pass over the centred rows (a task's share is X'(XB); the shares are added up by Spark), then takes
the best directions within the span of the iterate, its residuals and the previous directions
(Rayleigh-Ritz). It ends when residuals of a fresh product are under the bound. What passes through the
driver are blocks of (components of a vector) x (directions), whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import floored, matrix, one_length, summed, usable


@dataclass(frozen=True)
class WhitenConfig:
    #: An entry c of a vector is fitted as the integer floor(scale * c) + offset.
    scale: int = 64
    offset: int = 1_000_000
    components: int = 16
    #: Directions beside those, so that the last component is not held up by an eigenvalue next to it.
    guard: int = 8
    #: Certified: |V u - e u| is at most this share of the largest eigenvalue, for every component u.
    residual: float = 1e-12
    #: Eigenvalues up to this share of the trace are rounding: there is nothing to whiten along.
    rank: float = 1e-12
    #: More iterations than this are an error; nothing uncertified is returned.
    iterations: int = 1000
    seed: int = 11


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``n`` fit rows with ``sums`` per dimension, eigenvalues falling."""

    config: WhitenConfig
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    #: Largest certified residual as a share of the largest eigenvalue, and iterations taken.
    residual: float
    iterations: int
    #: Largest absolute entry of the covariance of the whitened fit rows minus the identity.
    identity_error: float


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n; the difference is taken in integers, so the large offset costs no digits."""
    return (n * x - sums) / n


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the span of the orthonormal ``against``."""
    length = np.linalg.norm(block, axis=0)
    block = block[:, length > 0] / length[length > 0]
    for _ in range(2):  # twice is enough
        block = block - against @ (against.T @ block)
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8]
    return block


def lobpcg(times: Callable[[np.ndarray], np.ndarray], start: np.ndarray, wanted: int, bound: float, iterations: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Leading eigenpairs of a symmetric matrix known by ``times(block)``: values, vectors, residual, iterations.

    ``start`` is a block of at least ``wanted`` directions. Values fall; the residual is the largest of the
    wanted ones as a share of the largest value, from a product made for that alone.
    """

    def ritz(basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = basis.T @ product
        e, c = np.linalg.eigh((h + h.T) / 2)
        return e[::-1], c[:, ::-1]

    size = start.shape[1]
    x, _ = np.linalg.qr(start)
    ax = times(x)
    before = np.zeros((len(x), 0))
    e, c = ritz(x, ax)
    x, ax = x @ c, ax @ c
    fresh = True
    for i in range(1, iterations + 1):
        left = ax - x * e
        length = np.linalg.norm(left, axis=0)
        limit = bound * max(abs(e[0]), np.finfo(float).tiny)
        if (length[:wanted] <= limit).all():
            if fresh:
                return e[:wanted], x[:, :wanted], float(length[:wanted].max(initial=0) / max(abs(e[0]), np.finfo(float).tiny)), i
            x, _ = np.linalg.qr(x)
            ax, fresh = times(x), True
            e, c = ritz(x, ax)
            x, ax = x @ c, ax @ c
            continue
        # Directions that are settled add rounding only.
        new = _orthonormal(left[:, length > limit / 10], x)
        new = np.hstack([new, _orthonormal(before, np.hstack([x, new]))])
        basis, product = np.hstack([x, new]), np.hstack([ax, times(new)])
        e, c = ritz(basis, product)
        e, c = e[:size], c[:, :size]
        x, ax, before, fresh = basis @ c, product @ c, new @ c[size:], False
    raise ArithmeticError(f"no certified eigenvectors after {iterations} iterations")


def fit(vectors: DataFrame, config: WhitenConfig = WhitenConfig(), column: str = "embedding") -> Whitening | None:
    """The whitening of the distinct usable vectors; None where there are none.

    Every distinct integer vector counts once, so copies do not weigh. Vectors of several lengths are an
    error. Fewer than ``config.components`` components come out where vectors have fewer entries or the
    covariance has a lower rank (one vector only: none).
    """
    x = vectors.select(F.col(column).cast("array<double>").alias("v")).where(usable(F.col("v"))).select(floored(F.col("v"), config.scale, config.offset).alias("x"))
    x = materialize(x.distinct(), "whiten")
    n, d = one_length(x, "x")
    if not n:
        return None
    sums = summed(x, d, lambda a: a.sum(axis=0)[:, None], 1, "bigint")[:, 0]
    trace = float(summed(x, d, lambda a: (_centred(a, n, sums) ** 2).sum(axis=0)[:, None], 1).sum() / n)

    def times(block: np.ndarray) -> np.ndarray:
        def share(a: np.ndarray) -> np.ndarray:
            c = _centred(a, n, sums)
            return c.T @ (c @ block)

        return summed(x, d, share, block.shape[1]) / n if block.shape[1] else np.zeros((d, 0))

    wanted = min(config.components, d)
    start = np.random.default_rng(config.seed).standard_normal((d, min(d, wanted + config.guard)))
    e, u, residual, iterations = lobpcg(times, start, wanted, config.residual, config.iterations)
    some = e > config.rank * trace
    e, u = e[some], u[:, some]
    onto = u / np.sqrt(e)

    def covariance(a: np.ndarray) -> np.ndarray:
        y = _centred(a, n, sums) @ onto
        return y.T @ y

    error = float(np.abs(summed(x, d, covariance, len(e)) / n - np.eye(len(e))).max()) if len(e) else 0.0
    return Whitening(config, n, sums, e, u, trace, residual, iterations, error)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Sum over dimensions of (n*x - sums)^2, exact; what no long holds is an error."""
    far = n * x - sums
    if int(np.abs(far).max(initial=0)) ** 2 * far.shape[1] >= 2**63:
        far = far.astype(object)
    return [int(v) for v in (far * far).sum(axis=1)]


OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, fitted: Whitening | None, column: str = "embedding") -> DataFrame:
    """One row for every usable row of ``vectors`` and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Null vectors, empty ones and those with null or non-finite entries give no rows; repeated rows and
    null ids are kept as they are; other columns are ignored. Without a fit (an empty table) there are no
    rows. Where eigenvalues are equal any orthonormal basis of their space may come out, one for all rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).where(usable(F.col("v")))
    if fitted is None:
        return rows.sparkSession.createDataFrame([], OUT)
    config, d, k = fitted.config, len(fitted.sums), len(fitted.values)
    onto, share = fitted.vectors / np.sqrt(fitted.values), fitted.values / fitted.trace if k else fitted.values

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x, m = matrix(part.column(1), d), part.num_rows
                rows_of = lambda a: np.repeat(a, k)
                y = _centred(x, fitted.n, fitted.sums) @ onto
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows_of(np.arange(m)))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fitted.n)),
                        pa.array(_deviation(x, fitted.n, fitted.sums), pa.int64()).take(pa.array(rows_of(np.arange(m)))), pa.array(y.reshape(-1)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, fitted.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("vec_id", floored(F.col("v"), config.scale, config.offset).alias("x")).mapInArrow(task, OUT)
