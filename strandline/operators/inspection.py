"""Samples and summaries for the inspection of tracks and passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fuse import separated_top

#: Metres a second from which a step is a speed violation, and from which on it is two people.
VIOLATION, SPLIT = 14.0, 25.0
#: Seconds between crops of a partition, and how many it has at most.
CROP_GAP, CROPS = 0.45, 5


def step_samples(points: DataFrame, violation: float = VIOLATION, split: float = SPLIT) -> DataFrame:
    """Every timed point (track, frame, t, x, z) with its step from the last placed point before it.

    Adds previous_frame, elapsed, delta, speed (null within a microsecond) and severity:
    ``unprojected`` where the point has no place, else ``identity-split`` or ``speed-violation`` beyond
    the limits, else ``ok``. Points without a finite time are left out. One shuffle, by track; points of one
    time follow by frame, then by place.
    """
    placed = F.col("x").isNotNull() & F.col("z").isNotNull()
    before = Window.partitionBy("track").orderBy("t", "frame", "x", "z").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(placed, F.struct("frame", "t", "x", "z")), ignorenulls=True).over(before)
    timed = F.col("t").isNotNull() & ~F.isnan("t") & (F.abs("t") < float("inf"))
    rows = points.where(timed).withColumn("last", last)
    rows = rows.withColumns({"elapsed": F.col("t") - F.col("last.t"), "delta": F.when(placed, F.sqrt(F.pow(F.col("x") - F.col("last.x"), 2) + F.pow(F.col("z") - F.col("last.z"), 2)))})
    speed = F.when(F.col("elapsed") > 1e-6, F.col("delta") / F.col("elapsed"))
    severity = F.when(~placed, "unprojected").when(speed > split, "identity-split").when(speed > violation, "speed-violation").otherwise("ok")
    return rows.select("track", "frame", "t", F.col("last.frame").alias("previous_frame"), "elapsed", "delta", speed.alias("speed"), severity.alias("severity"))


def population_edges(samples: DataFrame, violation: float = VIOLATION, split: float = SPLIT) -> DataFrame:
    """Of the samples of ``step_samples``, for each pair of frames that steps join: tracks compared, and
    those beyond each limit (a split is a violation too).

    A track counts once for a frame, by its first sample there, as the earliest is the one looked up.
    """
    of_frame = Window.partitionBy("track", "frame").orderBy("t", F.col("previous_frame").asc_nulls_first(), F.col("speed").asc_nulls_first())
    first = samples.withColumn("k", F.row_number().over(of_frame)).where((F.col("k") == 1) & F.col("previous_frame").isNotNull())
    beyond = lambda limit: F.count_if(F.coalesce(F.col("speed"), F.lit(0.0)) > limit)
    return first.groupBy("previous_frame", "frame").agg(F.count("*").alias("compared"), beyond(violation).alias("violations"), beyond(split).alias("splits"))


def predicted_points(points: DataFrame, ahead: float, horizon: float = 0.35) -> DataFrame:
    """Where each track is ``ahead`` seconds after each of its points (track, id, t, x, z) at its last velocity.

    The velocity is carried no further than ``horizon``; a track's first point, and one within 0.0001 s of the
    one before, is where it was seen.
    """
    order = Window.partitionBy("track").orderBy("t", "id")
    rows = points.withColumn("last", F.lag(F.struct("t", "x", "z")).over(order))
    elapsed, carried = F.col("t") - F.col("last.t"), max(0.0, min(ahead, horizon))
    moved = lambda c: F.col(c) + F.when(elapsed > 1e-4, (F.col(c) - F.col(f"last.{c}")) / elapsed * carried).otherwise(0.0)
    return rows.select("track", "id", moved("x").alias("x"), moved("z").alias("z"))


def consensus(passes: DataFrame) -> DataFrame:
    """Per scene, over its ready passes (scene, status, verdict, balls, tracks, relation): how many there are, how
    many hold up by verdict, by ball samples (3), by tracks (6) or overlap, and the evidence score.

    A scene without a ready pass has zeros.
    """
    ready = F.col("status") == "ready"
    counted = lambda c: F.count_if(ready & c)
    sums = passes.groupBy("scene").agg(
        counted(F.lit(True)).alias("analyzed"),
        counted(F.col("verdict") == "pass").alias("metric"),
        counted(F.col("balls") >= 3).alias("ball"),
        counted(F.col("tracks") >= 6).alias("track"),
        counted(F.col("relation") == "replay-overlap").alias("overlapping"),
    )
    share = lambda c: F.col(c) / F.greatest("analyzed", F.lit(1))
    score = F.least(F.lit(1.0), F.col("analyzed") / 3) * 0.25 + share("metric") * 0.3 + share("ball") * 0.25 + share("track") * 0.2
    return sums.withColumn("evidence", F.round(score, 3))


def observation_score(confidence: Column, w: Column, h: Column, reid_status: Column, reid_usable: Column, number_status: Column) -> Column:
    """How well an observation shows a person: confidence by size, and what was read from it."""
    zero = F.lit(0.0)
    area = F.greatest(zero, F.coalesce(w, zero)) * F.greatest(zero, F.coalesce(h, zero))
    seen = F.greatest(zero, F.least(F.lit(1.0), F.coalesce(confidence, zero))) * F.least(F.lit(1.0), F.sqrt(area) / 180)
    read = F.when(number_status == "recognized", 0.45).when(number_status.isin("low-confidence", "ambiguous"), 0.18).otherwise(0.0)
    return seen + F.when(reid_status.isin("usable", "ready"), 0.25).otherwise(0.0) + F.when(F.coalesce(reid_usable, F.lit(False)), 0.25).otherwise(0.0) + read


def partition_crops(points: DataFrame, ranges: DataFrame, gap: float = CROP_GAP, cap: int = CROPS) -> DataFrame:
    """Crops of each track (track, id, frame, t, w, h, conf) for reading, apart in time within each split partition.

    ``ranges``: number, track, s, e, half open; a point's partition is the list of its track's ranges that it
    lies in, so points of no range are one too. Boxes without a finite positive size are left out. Adds
    the quality; best first by it, then confidence, time, frame, id; one is taken if at least ``gap`` from
    all taken, up to ``cap`` in a partition.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) & (F.col(c) > 0)
    between = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    aspect = F.greatest(F.lit(0.0), 1 - F.abs(F.col("w") / F.greatest(F.lit(1.0), "h") - 0.42) / 0.42)
    quality = between(0.5 * between(F.coalesce("conf", F.lit(0.0))) + 0.25 * F.least(F.lit(1.0), F.col("h") / 96) + 0.15 * F.least(F.lit(1.0), F.col("w") / 40) + 0.1 * aspect)
    good = points.where(finite("w") & finite("h") & F.col("frame").isNotNull()).withColumn("quality", quality)
    listed = ranges.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("number", "s", "e"))).alias("ranges"))
    inside = F.transform(F.filter("ranges", lambda r: (r["s"] <= F.col("t")) & (F.col("t") < r["e"])), lambda r: r["number"])
    rows = good.join(listed, "track", "left").withColumn("partition", F.concat_ws(",", inside)).drop("ranges")
    order = Window.partitionBy("track", "partition").orderBy(F.desc("quality"), F.desc("conf"), "t", "frame", "id")
    rows = rows.withColumn("k", F.row_number().over(order).cast("long"))
    key = F.struct("track", "partition")
    taken = separated_top(rows.select(key.alias("key"), F.col("quality").alias("conf"), F.col("k").alias("event_id"), "t"), "key", gap, cap)
    chosen = taken.select("key.track", "key.partition", F.col("event_id").alias("k"))
    return rows.join(chosen, ["track", "partition", "k"]).select("track", "partition", "id", "t", "quality")


def model_comparison(scenes: DataFrame) -> DataFrame:
    """Verdict on a new model for each scene: frames, unmatched observations inside of both models
    (baseline_inside, candidate_inside), changes of outside detections and of stable tracks.

    ``candidate`` where it gains observations at little cost, ``baseline`` where it loses them, else ``review``.
    """
    gain = F.col("candidate_inside") - F.col("baseline_inside")
    enough = F.greatest(F.lit(3), F.bround(F.greatest(F.lit(1), "frames") * F.lit(0.15)))
    better = (gain >= enough) & (F.col("outside_delta") <= enough) & (F.col("stable_delta") >= -1)
    worse = (gain <= -enough) & (F.col("outside_delta") >= -enough) & (F.col("stable_delta") < 0)
    return scenes.select("scene", gain.alias("gain"), F.when(better, "candidate").when(worse, "baseline").otherwise("review").alias("verdict"))


def fenced(publications: DataFrame, jobs: DataFrame, statuses: list[str]) -> DataFrame:
    """Publications (run_id, fingerprint, at) whose run still holds its fence: a job of the same run and
    fingerprint (run_id, fingerprint, status, expires_at) in one of ``statuses`` whose lease ends after them.

    All others are late and go, also those of an unknown run and those without a fingerprint.
    """
    held = jobs.where(F.col("status").isin(statuses)).select("run_id", "fingerprint", "expires_at").alias("j")
    same = (F.col("p.run_id") == F.col("j.run_id")) & (F.col("p.fingerprint") == F.col("j.fingerprint")) & (F.col("j.expires_at") > F.col("p.at"))
    return publications.alias("p").join(held, same, "left_semi")
