"""Small kernels that run once per scene or pair: path search, time warping, homographies."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


@dataclass(frozen=True)
class PathConfig:
    top: int = 6
    beam: int = 128
    occlusion: float = 1.35
    occlusion_rate: float = 0.2
    reacquire: float = 0.3
    speed_limit: float = 55.0
    least_peak: float = 0.12


def _step_cost(distance: float, dt: float, limit: float) -> float:
    r = distance / max(dt, 1e-6) / limit
    return 0.8 * r * r + 24.0 * max(0.0, r - 1) ** 2


def best_path(times: list[float], frames: list[list[tuple[float, float, float]]], config: PathConfig) -> list[int | None]:
    """Index of the candidate (x, z, confidence) chosen in each frame, or none; least total cost.

    States are kept by the last candidate seen and when; of equal states only the cheapest goes on.
    """
    beam: dict[tuple, tuple[float, list]] = {(-1, -1, False): (0.0, [])}
    for f, (t, cands) in enumerate(zip(times, frames)):
        dt = t - times[f - 1] if f else 0.0
        grown: dict[tuple, tuple[float, list]] = {}

        def offer(state: tuple, cost: float, path: list) -> None:
            if state not in grown or cost < grown[state][0] - 1e-12:
                grown[state] = (cost, path)

        for (lf, lc, hidden), (cost, path) in beam.items():
            offer((lf, lc, True), cost + config.occlusion + config.occlusion_rate * dt + (0.2 if not hidden else 0.0), [*path, None])
            for c, (x, z, conf) in enumerate(cands):
                step = -np.log(max(1e-4, conf)) + (config.reacquire if hidden and lf >= 0 else 0.0)
                if lf >= 0:
                    px, pz, _ = frames[lf][lc]
                    step += _step_cost(float(np.hypot(x - px, z - pz)), t - times[lf], config.speed_limit)
                offer((f, c, False), cost + step, [*path, c])
        beam = dict(sorted(grown.items(), key=lambda kv: (kv[1][0], kv[0]))[: config.beam])
    path = min(beam.items(), key=lambda kv: (kv[1][0], kv[0]))[1][1]
    seen = [frames[f][c][2] for f, c in enumerate(path) if c is not None]
    return path if len(seen) >= 2 and max(seen) >= config.least_peak else [None] * len(path)


def solve_paths(candidates: DataFrame, key: str, config: PathConfig = PathConfig()) -> DataFrame:
    """Per scene (key) with rows (frame, t, id, x, z, conf): the chosen candidate of each frame."""
    kind = candidates.schema[key].dataType.simpleString()

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame", "conf", "id"], ascending=[True, False, True], kind="stable")
        numbers, times, frames, ids = [], [], [], []
        for frame, group in rows.groupby("frame", sort=True):
            group = group.head(config.top)
            numbers.append(frame)
            times.append(float(group["t"].iloc[0]))
            frames.append(list(zip(group["x"], group["z"], group["conf"])))
            ids.append(list(group["id"]))
        if any(b <= a for a, b in zip(times, times[1:])):
            raise ValueError("times of frames must rise")
        path = best_path(times, frames, config)
        return pd.DataFrame({key: [rows[key].iloc[0]] * len(path), "frame": numbers, "id": [None if c is None else ids[f][c] for f, c in enumerate(path)]}).astype({"id": "Int64"})

    return candidates.select(key, "frame", "t", "id", "x", "z", "conf").groupBy(key).applyInPandas(solve, f"{key} {kind}, frame bigint, id bigint")


def warp(a: np.ndarray, b: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """Time warping of two series by absolute differences: cost over both lengths, and the path."""
    n, m = len(a), len(b)
    if n < 2 or m < 2:
        return 1.0, []
    cost = np.abs(np.asarray(a, float)[:, None] - np.asarray(b, float)[None])
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            total[i, j] = cost[i - 1, j - 1] + min(total[i - 1, j - 1], total[i - 1, j], total[i, j - 1])
    i, j, path = n, m, []
    while i and j:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: total[p])
    return float(total[n, m] / (n + m)), path[::-1]


def resampled(points: DataFrame, key: str, value: str, bins: int) -> DataFrame:
    """(key, v): each key's whole series (t, value) as means over ``bins`` equal times of its span.

    A time without points takes the mean before it. A key of fewer than two points has one element.
    """
    span = points.groupBy(key).agg(F.min("t").alias("from_"), F.max("t").alias("to_"), F.count("*").alias("points_"))
    place = F.when(F.col("to_") > F.col("from_"), F.least(F.lit(bins - 1), F.floor((F.col("t") - F.col("from_")) / (F.col("to_") - F.col("from_")) * bins))).otherwise(0).cast("int")
    means = points.join(span, key).groupBy(key, place.alias("bin")).agg(F.avg(value).alias("mean"), F.first("points_").alias("points_"))
    lists = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bin", "mean"))).alias("m"), F.first("points_").alias("points_"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.element_at(F.filter("m", lambda s: s["bin"] <= k), -1)["mean"])
    return lists.select(key, F.when(F.col("points_") < 2, F.slice(whole, 1, 1)).otherwise(whole).alias("v"))


@F.pandas_udf(DoubleType())
def warp_cost(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([warp(np.asarray(x), np.asarray(y))[0] for x, y in zip(a, b)])


def fit_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Direct linear fit of a 3x3 matrix to point pairs, both sides centred and scaled first."""
    if len(src) < 4:
        return None

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = p.mean(0)
        s = np.sqrt(2) / max(1e-12, np.sqrt(((p - c) ** 2).sum(1)).mean())
        return (p - c) * s, np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    (p, tp), (q, tq) = scaled(np.asarray(src, float)), scaled(np.asarray(dst, float))
    rows = []
    for (x, y), (u, v) in zip(p, q):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    h = np.linalg.inv(tq) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ tp
    return None if abs(h[2, 2]) < 1e-12 else h / h[2, 2]


@F.pandas_udf(ArrayType(DoubleType()))
def homography(src: pd.Series, dst: pd.Series) -> pd.Series:
    """Row-major matrix from two arrays of points (array<array<double>>)."""
    out = []
    for s, d in zip(src, dst):
        h = fit_homography(np.array([list(p) for p in s]), np.array([list(p) for p in d]))
        out.append(None if h is None else h.reshape(-1).tolist())
    return pd.Series(out)
