"""Joins: as-of, bracketing, intervals, boxes, queue state and reconciliation.

Range conditions become equi joins on time buckets, so they shuffle by key instead of comparing all
with all; outer sides are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou


def asof_nearest(left: DataFrame, right: DataFrame, by: str, tolerance: float) -> DataFrame:
    """Each left row (id, by, t) with the nearest right row within the tolerance, or null.

    Ties: the earlier, then the smaller id. Right times are put into buckets as wide as the
    tolerance; a left row looks into its own and both neighbours, so no row is missed.
    """
    bucket = lambda c: F.floor(c / tolerance)
    r = right.select(by, F.col("t").alias("rt"), F.col("id").alias("rid"), bucket(F.col("t")).alias("b_"))
    asked = left.select("id", by, "t").withColumn("b_", F.explode(F.array(*[bucket(F.col("t")) + k for k in (-1, 0, 1)])))
    near = asked.join(r, [by, "b_"])
    near = near.where(F.abs(F.col("t") - F.col("rt")) <= tolerance)
    best = near.groupBy("id").agg(F.min(F.struct(F.abs(F.col("t") - F.col("rt")).alias("d"), "rt", "rid")).alias("best"))
    return left.select("id", by, "t").join(best, "id", "left").select("id", F.col(by), F.col("best.rid").alias("match_id"), F.col("best.d").alias("distance"))


def bracketing(left: DataFrame, anchors: DataFrame, by: str, horizon: float, most: int = 2) -> DataFrame:
    """Up to ``most`` anchors at each side of a left row (id, by, t), at most ``horizon`` away."""
    bucket = lambda c: F.floor(c / horizon)
    a = anchors.select(F.col(by), F.col("t").alias("at"), F.col("id").alias("aid"), bucket(F.col("t")).alias("b_"))
    asked = left.select("id", by, "t").withColumn("b_", F.explode(F.array(*[bucket(F.col("t")) + k for k in (-1, 0, 1)])))
    near = asked.join(a, [by, "b_"]).where((F.abs(F.col("t") - F.col("at")) <= horizon) & (F.col("at") != F.col("t")))
    near = near.withColumn("side", F.when(F.col("at") < F.col("t"), "before").otherwise("after"))
    w = Window.partitionBy("id", "side").orderBy(F.abs(F.col("t") - F.col("at")), "aid")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("id", "side", "rank", F.col("aid").alias("anchor_id"))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Half-open intervals; one of no length is a point, inside where start <= point < end."""
    points = (s1 == e1) & (s2 == e2) & (s1 == s2)
    return points | (F.greatest(s1, s2) < F.least(e1, e2)) | ((s1 == e1) & (s2 <= s1) & (s1 < e2)) | ((s2 == e2) & (s1 <= s2) & (s2 < e1))


def interval_pairs(intervals: DataFrame, width: float = 32.0) -> DataFrame:
    """Overlapping pairs (a < b) of one owner's intervals; each pair is met in one bucket only."""
    rows = intervals.withColumn("b_", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.greatest(F.col("s"), F.col("e")) / width))))
    a, b = (rows.select("owner", "b_", F.col("id").alias(f"id_{k}"), F.col("s").alias(f"s_{k}"), F.col("e").alias(f"e_{k}")) for k in "ab")
    pairs = a.join(b, ["owner", "b_"]).where((F.col("id_a") < F.col("id_b")) & overlaps(*(F.col(c) for c in ("s_a", "e_a", "s_b", "e_b"))))
    return pairs.where(F.col("b_") == F.floor(F.greatest("s_a", "s_b") / width)).select("owner", "id_a", "id_b", (F.least("e_a", "e_b") - F.greatest("s_a", "s_b")).alias("overlap"))


def time_gated_pairs(intervals: DataFrame, gate: float) -> DataFrame:
    """Pairs of one owner in which the second begins after the first ended, at most ``gate`` later."""
    bucket = lambda c: F.floor(c / gate)
    a = intervals.select("owner", F.col("id").alias("id_a"), F.col("e").alias("end_a")).withColumn("b_", F.explode(F.array(bucket(F.col("end_a")), bucket(F.col("end_a")) + 1)))
    b = intervals.select("owner", F.col("id").alias("id_b"), F.col("s").alias("start_b"), bucket(F.col("s")).alias("b_"))
    gap = F.col("start_b") - F.col("end_a")
    return a.join(b, ["owner", "b_"]).where((F.col("id_a") != F.col("id_b")) & (gap >= 0) & (gap <= gate)).select("owner", "id_a", "id_b", gap.alias("gap"))


def interval_union(intervals: DataFrame) -> DataFrame:
    """Each owner's intervals merged where they touch or overlap."""
    w = Window.partitionBy("owner").orderBy("s", "e", "id")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    rows = rows.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("owner", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"))


def interval_coverage(intervals: DataFrame) -> DataFrame:
    """Per owner: covered time over the span from first start to last end."""
    merged = interval_union(intervals).groupBy("owner").agg(F.sum(F.col("e") - F.col("s")).alias("covered"), (F.max("e") - F.min("s")).alias("span"))
    return merged.select("owner", "covered", "span", F.try_divide("covered", "span").alias("coverage"))


def points_in_intervals(points: DataFrame, intervals: DataFrame, width: float = 32.0) -> DataFrame:
    """For each point (id, owner, t) how many of the owner's intervals hold it, and the first by start."""
    rows = intervals.select("owner", F.col("id").alias("iid"), "s", "e").withColumn("b_", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    asked = points.select("id", "owner", "t", F.floor(F.col("t") / width).alias("b_"))
    hits = asked.join(rows, ["owner", "b_"]).where((F.col("s") <= F.col("t")) & (F.col("t") < F.col("e")))
    found = hits.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("s", "iid")).alias("first"))
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.col("first.iid").alias("first_id"))


def breakpoint_bucket(value: Column, breaks: list[float]) -> Column:
    """Number of breakpoints not above the value."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in sorted(breaks)]), lambda b: b <= value))


def iou_pairs(boxes: DataFrame, least: float = 0.0) -> DataFrame:
    """Ground truth by prediction boxes of one frame with overlap over union above ``least``."""
    cols = ("id", "x", "y", "w", "h")
    g = boxes.where(F.col("side") == "gt").select("frame", *[F.col(c).alias(f"g_{c}") for c in cols])
    p = boxes.where(F.col("side") == "pred").select("frame", "score", *[F.col(c).alias(f"p_{c}") for c in cols])
    value = iou(*(F.col(f"{s}_{c}") for s in "gp" for c in cols[1:]))
    return g.join(p, "frame").withColumn("iou", value).where(F.col("iou") > least).select("frame", "g_id", "p_id", "score", "iou")


def distance_pairs(a: DataFrame, b: DataFrame, by: str, limit: float) -> DataFrame:
    """Pairs of one key whose places are at most ``limit`` apart."""
    left = a.select(by, F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("z").alias("az"))
    right = b.select(by, F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("z").alias("bz"))
    d = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("az") - F.col("bz")) * (F.col("az") - F.col("bz")))
    return left.join(right, by).withColumn("distance", d).where(F.col("distance") <= limit).select(by, "a_id", "b_id", "distance")


def spread_join(few: DataFrame, many: DataFrame, on: dict[str, str], by: str, salts: int = 16) -> DataFrame:
    """Inner join of ``few`` with ``many`` on columns of few values (``on``: of few, of many), with as many pairs as the
    product of a value's rows. The rows of ``many`` with one value are dealt by ``by`` to ``salts`` parts and
    those to a fixed number of tasks, since small tables with many pairs would be read by one or two."""
    session = few.sparkSession
    dealt = many.withColumn("salt_", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    dealt = dealt.repartition(max(64, 8 * session.sparkContext.defaultParallelism), *on.values(), "salt_")
    copied = few.withColumn("copy_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = F.col("copy_") == F.col("salt_")
    for a, b in on.items():
        same = same & (F.col(a) == F.col(b))
    return copied.join(dealt, same).drop("copy_", "salt_")


def frame_outer(boxes: DataFrame) -> DataFrame:
    """Frames with counts on both sides, also those with one side only."""
    count = lambda side: boxes.where(F.col("side") == side).groupBy("frame").agg(F.count("*").alias(f"n_{side}"))
    return count("gt").join(count("pred"), "frame", "full_outer").select("frame", F.coalesce("n_gt", F.lit(0)).alias("n_gt"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"))


def runnable_jobs(jobs: DataFrame, leases: DataFrame, active: list[str], processing: str, now: float) -> DataFrame:
    """Active jobs that are due (or in processing) without a live lease; a lease that ends now is dead."""
    due = jobs.where(F.col("status").isin(active) & ((F.col("status") == processing) | (F.col("available") <= now)))
    held = due.join(leases, due["id"] == leases["job_id"], "left").where(F.col("expires").isNull() | (F.col("expires") <= now))
    return held.select("id", "status", "available", "requested", F.col("job_id").isNotNull().alias("had_lease"))


def live_claims(jobs: DataFrame, leases: DataFrame, now: float) -> DataFrame:
    return jobs.join(leases, jobs["id"] == leases["job_id"]).where(F.col("expires") > now).select("id", "status", "expires")


def reconcile(existing: DataFrame, incoming: DataFrame, key: str, value: str) -> DataFrame:
    """What to do with each key: insert, delete, update or keep."""
    a = existing.select(key, F.col(value).alias("old"))
    b = incoming.select(key, F.col(value).alias("new"))
    both = a.withColumn("has_old", F.lit(True)).join(b.withColumn("has_new", F.lit(True)), key, "full_outer")
    action = F.when(F.col("has_old").isNull(), "insert").when(F.col("has_new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update").otherwise("keep")
    return both.select(key, action.alias("action"))


def unknown_references(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    return rows.join(known.select(F.col(known_key).alias("k_")), F.col(key) == F.col("k_"), "left_anti")


def require_known(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """The rows as they are; a row with an unknown reference makes the job fail."""
    marked = known.select(F.col(known_key).alias("k_")).distinct()
    joined = rows.join(marked, F.col(key) == F.col("k_"), "left")
    checked = F.when(F.col("k_").isNotNull(), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return joined.withColumn(key, checked.cast(rows.schema[key].dataType)).drop("k_")


def cache_split(asked: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows with ``hit``: whether the newest cache row of the key exists (newest by mtime)."""
    newest = cache.groupBy(key).agg(F.max_by("value", F.struct("mtime", "value")).alias("cached"), F.lit(True).alias("hit"))
    return asked.join(newest, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
