"""Corrections and calibration lineage: which record an edit means, who wins, what it touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou, multiply


@dataclass(frozen=True)
class ResolveConfig:
    least_iou: float = 0.50
    most_offset: float = 0.50


def resolve_unique(corrections: DataFrame, observations: DataFrame, config: ResolveConfig = ResolveConfig()) -> DataFrame:
    """The one observation that a correction's box means: same frame, enough overlap, centres near.

    Both: (id, frame, x, y, w, h). None or several make the job fail; it never picks a neighbour.
    """
    box = ("x", "y", "w", "h")
    c = corrections.select("frame", F.col("id").alias("correction"), *[F.col(b).alias(f"c_{b}") for b in box])
    o = observations.select("frame", F.col("id").alias("observation"), *[F.col(b).alias(f"o_{b}") for b in box])
    near = iou(*(F.col(f"{s}_{b}") for s in "co" for b in box)) >= config.least_iou
    for at, size in (("x", "w"), ("y", "h")):
        middle = lambda s: F.col(f"{s}_{at}") + F.col(f"{s}_{size}") / 2  # noqa: B023, E731
        near = near & (F.abs(middle("c") - middle("o")) <= config.most_offset * F.col(f"c_{size}"))
    found = c.join(o, "frame").where(near).groupBy("correction").agg(F.count("*").alias("n"), F.min("observation").alias("observation"))
    all_ = c.select("correction").join(found, "correction", "left")
    failed = F.raise_error(F.concat(F.lit("correction "), F.col("correction").cast("string"), F.lit(" matches "), F.coalesce("n", F.lit(0)).cast("string"))).cast(observations.schema["id"].dataType)
    return all_.select("correction", F.when(F.col("n") == 1, F.col("observation")).otherwise(failed).alias("observation"))


def split_tracks(points: DataFrame, splits: DataFrame) -> DataFrame:
    """Points whose time is in a split's half-open range go to the split's new track; the split that
    starts first, then the smaller new id, wins. ``splits``: (track_id, start, stop, new_id)."""
    ranges = splits.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("start", "new_id", "stop"))).alias("ranges"))
    hit = F.try_element_at(F.filter("ranges", lambda r: (r["start"] <= F.col("t")) & (F.col("t") < r["stop"])), F.lit(1))
    return points.join(ranges, "track_id", "left").withColumn("new_track", F.coalesce(hit["new_id"], F.col("track_id"))).drop("ranges")


def merge_points(points: DataFrame, into: Column, digits: int = 4) -> DataFrame:
    """Tracks joined by ``into``: one point per rounded time; annotated ones first, then confidence,
    then the later in source order. ``points``: (event_id, track_id, t, conf, annotated)."""
    rows = points.withColumn("track", into).withColumn("rt", F.floor(F.col("t") * 10**digits + 0.5) / 10**digits)
    best = rows.groupBy("track", "rt").agg(F.max(F.struct("annotated", "conf", "event_id")).alias("b"), F.count("*").alias("n"))
    return best.select("track", "rt", F.col("b.event_id").alias("event_id"), "n")


def roster_conflict(a: Column, b: Column) -> Column:
    """A bound track against another binding, or against none."""
    return ~a.eqNullSafe(b)


def latest_manual(log: DataFrame, by: str) -> DataFrame:
    """The last known value of each field of an append-only log (by, order, splits rank last, fields...)."""
    order = [c for c in ("is_split", "updated", "t", "frame", "id") if c in log.columns]
    fields = [c for c in log.columns if c not in (by, *order)]
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return log.select(by, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in fields]).distinct()


def best_attempt(attempts: DataFrame, by: str) -> DataFrame:
    """Per key the attempt of the best rank: status, fewer reasons, smaller residual, confidence,
    inliers; the first attempt on a tie. ``attempts``: (by, attempt, status_rank, reasons, residual, confidence, inliers)."""
    rank = F.struct("status_rank", (-F.col("reasons")).alias("r"), (-F.col("residual")).alias("d"), "confidence", "inliers", (-F.col("attempt")).alias("a"))
    return attempts.groupBy(by).agg(F.max(rank).alias("b")).select(by, (-F.col("b.a")).alias("attempt"), F.col("b.status_rank").alias("status_rank"))


def affected_samples(samples: DataFrame, anchors: DataFrame, by: str, horizon: float) -> DataFrame:
    """Samples (id, by, t) that an edit of ``anchors`` (by, t) may reach, without the edited times."""
    bucket = lambda c: F.floor(c / horizon)
    a = anchors.select(by, F.col("t").alias("at"), F.explode(F.array(*[bucket(F.col("t")) + k for k in (-1, 0, 1)])).alias("b_"))
    near = samples.withColumn("b_", bucket(F.col("t"))).join(a, [by, "b_"]).where(F.abs(F.col("t") - F.col("at")) <= horizon)
    direct = anchors.select(by, "t").distinct()
    return near.join(direct, [by, "t"], "left_anti").select("id").distinct()


@dataclass(frozen=True)
class ContextConfig:
    exact: float = 1e-6
    interval: float = 0.25


def dense_context(frames: DataFrame, samples: DataFrame, by: str, config: ContextConfig = ContextConfig()) -> DataFrame:
    """How each frame (id, by, t) gets its calibration from ``samples`` (by, t, accepted): exact,
    interpolated between two accepted neighbours, or from the nearest one, with the reason.

    Both series are merged, so one window finds the neighbours of every frame.
    """
    both = frames.select(by, "t", "id", F.lit(None).cast("boolean").alias("accepted")).unionByName(samples.select(by, "t", "accepted").withColumn("id", F.lit(None).cast(frames.schema["id"].dataType)))
    w = Window.partitionBy(by).orderBy("t", F.col("id").isNotNull(), "id")
    here = F.when(F.col("id").isNull(), F.struct("t", "accepted"))
    rows = both.withColumns({"a": F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where(F.col("id").isNotNull())
    reason = (
        F.when(F.abs(F.col("t") - F.col("a.t")) <= config.exact, "exact")
        .when(F.col("a").isNull() | F.col("b").isNull(), "outside-bracket")
        .when(F.col("b.t") - F.col("a.t") > config.interval, "interval-too-long")
        .when(~(F.col("a.accepted") & F.col("b.accepted")), "end-not-accepted")
        .otherwise("interpolated")
    )
    alpha = F.try_divide(F.col("t") - F.col("a.t"), F.col("b.t") - F.col("a.t"))
    return rows.select("id", reason.alias("reason"), F.when(reason == "interpolated", alpha).alias("alpha"))


def motion_chain(targets: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """Product of the 3x3 matrices of the edges from ``start`` to ``stop`` of each target, in order;
    null where one is missing. ``targets``: (id, by, start, stop); ``edges``: (by, at, h)."""
    steps = targets.select("id", by, "start", "stop", F.explode(F.sequence("start", F.col("stop") - 1)).alias("at")).where(F.col("start") < F.col("stop"))
    laid = steps.join(edges, [by, "at"], "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("s"), F.bool_and(F.col("h").isNotNull()).alias("whole"))
    one = F.array(*[F.lit(1.0 if k % 4 == 0 else 0.0) for k in range(9)])
    return laid.select("id", F.when(F.col("whole"), F.aggregate("s", one, lambda m, e: multiply(e["h"], m))).alias("h"))
