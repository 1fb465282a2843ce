"""Ordering, gating and checking of results that people look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recommended_shots(shots: DataFrame, limit: int = 5, least: float = 4.0) -> DataFrame:
    """Every shot (owner, id, score, duration) with ``recommended``: among its owner's ``limit`` best of
    ``least`` length or more, by score, then duration, then id."""
    order = Window.partitionBy("owner", "long").orderBy(F.desc("score"), F.desc("duration"), "id")
    rows = shots.withColumn("long", F.col("duration") >= least)
    return rows.withColumn("recommended", F.col("long") & (F.row_number().over(order) <= limit)).drop("long")


def ordered_jobs(jobs: DataFrame, active: list[str]) -> DataFrame:
    """Jobs with their place: active ones first, then the latest, then by id. Places are counted within
    the day and added up over days, so no task sorts all jobs."""
    rows = jobs.withColumn("rest", (~F.col("status").isin(active)).cast("int"))
    days = rows.groupBy("rest", F.col("available").alias("day")).agg(F.count("*").alias("n"))
    before = days.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("rest", F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = Window.partitionBy("rest", "available").orderBy("id")
    placed = rows.withColumn("k", F.row_number().over(within)).join(before.withColumnRenamed("day", "available"), ["rest", "available"])
    return placed.select("id", "status", (F.col("before") + F.col("k")).alias("place"))


def hits_under_point(boxes: DataFrame, x: float, y: float, least: float = 0.0) -> DataFrame:
    """Boxes of each frame under a point, best first: frame, id, rank.

    A box smaller than ``least`` is hit as if it had that size. Real hits come first, then the smaller
    area, the nearer centre, the higher score, the id.
    """
    half = lambda c: F.greatest(F.col(c), F.lit(least)) / 2
    dx, dy = F.abs(F.lit(x) - F.col("x") - F.col("w") / 2), F.abs(F.lit(y) - F.col("y") - F.col("h") / 2)
    rows = boxes.where((dx <= half("w")) & (dy <= half("h")))
    real = (dx <= F.col("w") / 2) & (dy <= F.col("h") / 2)
    order = Window.partitionBy("frame").orderBy(real.desc(), F.col("w") * F.col("h"), dx * dx + dy * dy, F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).select("frame", "id", "rank")


def interior_gaps(frames: DataFrame) -> DataFrame:
    """Per track: distinct frames, and steps of more than one frame between neighbours."""
    w = Window.partitionBy("track").orderBy("frame")
    step = F.col("frame") - F.lag("frame").over(w)
    return frames.select("track", "frame").distinct().withColumn("gap", (F.coalesce(step, F.lit(1)) > 1).cast("int")).groupBy("track").agg(F.count("*").alias("frames"), F.sum("gap").alias("gaps"))


def presence_at(points: DataFrame, times: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """State of every track (track_id, t, observed) at each time q of a stated set: observed,
    outside-observed-window or inferred-gap; and ``inferred``: a neighbour at or around q is not observed.

    Neighbours are found by merging the times into each track's series; before the first point and after
    the last one that point alone counts.
    """
    asked = points.select("track_id").distinct().crossJoin(times.select("q"))
    both = points.select("track_id", "t", "observed", "event_id", F.lit(None).cast("double").alias("q")).unionByName(asked.select("track_id", F.col("q").alias("t"), "q"), allowMissingColumns=True)
    # A time stands before the points at that very time.
    w = Window.partitionBy("track_id").orderBy("t", F.col("q").isNull(), "event_id")
    back, ahead, whole = (w.rowsBetween(*r) for r in ((Window.unboundedPreceding, 0), (0, Window.unboundedFollowing), (Window.unboundedPreceding, Window.unboundedFollowing)))
    here, seen = F.when(F.col("q").isNull(), F.struct("t", "observed")), F.when(F.col("observed"), F.col("t"))
    first, last = (lambda c, over: F.first(c, ignorenulls=True).over(over)), (lambda c, over: F.last(c, ignorenulls=True).over(over))
    rows = both.withColumns(
        {"a": last(here, back), "b": first(here, ahead), "begin": first(here, whole), "end": last(here, whole), "sa": last(seen, back), "sb": first(seen, ahead), "from": F.min(seen).over(whole), "to": F.max(seen).over(whole)}
    ).where(F.col("q").isNotNull())
    near = F.least(F.coalesce(F.col("q") - F.col("sa"), F.lit(1e18)), F.coalesce(F.col("sb") - F.col("q"), F.lit(1e18))) <= tolerance
    state = F.when(near, "observed").when((F.col("q") < F.col("from")) | (F.col("q") > F.col("to")), "outside-observed-window").otherwise("inferred-gap")
    hidden = F.when(F.col("q") <= F.col("begin.t"), ~F.col("begin.observed")).when(F.col("q") >= F.col("end.t"), ~F.col("end.observed")).otherwise(~F.col("a.observed") | ~F.col("b.observed"))
    return rows.select("track_id", "q", state.alias("state"), hidden.alias("inferred"))


def person_gate(x: Column, y: Column, w: Column, h: Column, height: Column, confidence: Column, grass: Column) -> Column:
    """Why a detection on a frame of some height is taken for a person on the pitch, or not.

    ``grass``: the share of green below the feet, measured before.
    """
    foot = y + h
    strong = (confidence >= 0.55) & (foot >= height * 0.24) & (grass >= 0.15)
    shallow = (confidence >= 0.12) & ((grass >= 0.52) | (confidence >= 0.55))
    return (
        F.when((h < 14) | (w < 5) | (h < w * 1.05), "rejected-box-shape")
        .when(foot < height * 0.18, "rejected-foot-above-horizon")
        .when((grass < 0.38) & ~strong, "rejected-off-grass")
        .when(foot < height * 0.34, F.when(shallow, "accepted-shallow").otherwise("rejected-shallow-low-confidence"))
        .otherwise("accepted")
    )


# Names of the detector's classes, and their numbers where no name is known.
PERSONS, BALLS = ("person", "player", "goalkeeper", "referee", "staff"), ("ball", "sports ball")
PERSON_ID, BALL_ID = 0, 32


def detection_kind(number: Column, name: Column, any_person: Column) -> Column:
    """person, ball or other; without any person among the model's names the numbers decide."""
    low = F.lower(F.trim(name))
    named = F.when(low.isin(*PERSONS), "person").when(low.isin(*BALLS), "ball").otherwise("other")
    return F.when(any_person, named).otherwise(F.when(number == PERSON_ID, "person").when(number == BALL_ID, "ball").otherwise("other"))


def keyframes(scenes: DataFrame) -> DataFrame:
    """scene, kind, track, t, x of all keyframes: of tracks (array of struct(id, keyframes)) and the ball."""
    people = scenes.select("scene", F.explode("tracks").alias("k")).select("scene", F.lit("person").alias("kind"), F.coalesce(F.col("k.id"), F.lit("unknown")).alias("track"), F.explode("k.keyframes").alias("f"))
    ball = scenes.select("scene", F.lit("ball").alias("kind"), F.lit("ball").alias("track"), F.explode("ball").alias("f"))
    return people.unionByName(ball).select("scene", "kind", "track", "f.*")


def without_frames(rows: DataFrame, excluded: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose frame is not excluded."""
    return rows.join(excluded.select(*on).distinct(), on, "left_anti")


def annotation_sides(annotations: DataFrame, points: DataFrame) -> DataFrame:
    """Which side of a split (range s <= t < e of its track, or what remains) an annotation belongs to.

    ``annotations``: id, track, s, e, observation, time; ``points``: track, t, annotation, observation. A point
    that names the annotation decides, then one with its observation, then its time; evidence on both
    sides is ambiguous, none at all unknown.
    """
    inside = (F.col("p.t") >= F.col("a.s")) & (F.col("p.t") < F.col("a.e"))
    flags = {}
    for name, hit in (("point", F.col("p.annotation") == F.col("a.id")), ("seen", F.col("p.observation") == F.col("a.observation"))):
        flags |= {f"{name}_in": F.coalesce(F.bool_or(hit & inside), F.lit(False)), f"{name}_out": F.coalesce(F.bool_or(hit & ~inside), F.lit(False))}
    names = ["id", "track", "s", "e", "observation", "time"]
    joined = annotations.alias("a").join(points.alias("p"), F.col("a.track") == F.col("p.track"), "left")
    rows = joined.groupBy(*(F.col(f"a.{c}").alias(c) for c in names)).agg(*(v.alias(k) for k, v in flags.items()))

    def side(name: str, otherwise: Column) -> Column:
        yes, no = F.col(f"{name}_in"), F.col(f"{name}_out")
        return F.when(yes & no, "ambiguous").when(yes, "range").when(no, "remaining").otherwise(otherwise)

    by_time = F.when(F.col("time").isNull() | F.isnan("time"), "unknown").when((F.col("time") >= F.col("s")) & (F.col("time") < F.col("e")), "range").otherwise("remaining")
    return rows.select("id", side("point", side("seen", by_time)).alias("side"))


def pixel_scale(width: Column, height: Column) -> Column:
    """Factor from pixels of a frame to pixels of one of 960 x 540, by the diagonals."""
    return F.sqrt(F.lit(960.0 * 960 + 540.0 * 540)) / F.greatest(F.lit(1.0), F.sqrt(width * width + height * height))


def line_residuals(lines: DataFrame) -> DataFrame:
    """Distance of an observed line's ends (x1, y1, x2, y2) from the line through (mx1, my1), (mx2, my2):
    id, p50, p95, status; model lines without a length, or without a match, are not scored."""
    dx, dy = F.col("mx2") - F.col("mx1"), F.col("my2") - F.col("my1")
    length = F.sqrt(dx * dx + dy * dy)
    away = [F.abs(dx * (F.col(f"y{k}") - F.col("my1")) - dy * (F.col(f"x{k}") - F.col("mx1"))) / length for k in (1, 2)]
    low, high = F.least(*away), F.greatest(*away)
    scored = F.coalesce(F.col("ground") & (length >= 1e-7), F.lit(False))
    status = F.when(~F.coalesce("ground", F.lit(True)), "not-scored-3d").when(scored, "scored").otherwise("not-scored")
    at = lambda q: F.when(scored, F.round(low + (high - low) * q, 3))
    return lines.select("id", at(0.5).alias("p50"), at(0.95).alias("p95"), status.alias("status"))


def alignment(residuals: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Per frame: precision (model samples near an observed line), recall (observed ones near the model), f1,
    and the model samples' median and 95th percentile in pixels of the reference size.

    ``residuals``: frame, side ('model' or 'observed'), distance, scale.
    """
    near = (F.col("distance") * F.col("scale") <= tolerance).cast("double")
    model = F.col("side") == "model"
    rows = residuals.groupBy("frame").agg(
        F.avg(F.when(model, near)).alias("precision"), F.avg(F.when(~model, near)).alias("recall"),
        F.percentile(F.when(model, F.col("distance") * F.col("scale")), 0.5).alias("p50"), F.percentile(F.when(model, F.col("distance") * F.col("scale")), 0.95).alias("p95"),
    )
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-9), F.col("precision") + F.col("recall"))
    return rows.where("precision is not null and recall is not null").select("frame", "precision", "recall", f1.alias("f1"), "p50", "p95")


def set_relations(a: DataFrame, b: DataFrame, by: str, item: str) -> DataFrame:
    """Per key: whether a's items are a subset of b's, share none with them, or are the same set."""
    both = a.select(by, item).distinct().withColumn("a", F.lit(1)).join(b.select(by, item).distinct().withColumn("b", F.lit(1)), [by, item], "full_outer")
    counted = both.groupBy(by).agg(F.count("a").alias("na"), F.count("b").alias("nb"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n"))
    return counted.select(by, (F.col("n") == F.col("na")).alias("subset"), (F.col("n") == 0).alias("disjoint"), ((F.col("n") == F.col("na")) & (F.col("n") == F.col("nb"))).alias("same"))
