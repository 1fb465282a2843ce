"""Queries of borrowed and agreed calibrations: a track's events are the samples of a scene, moved along x."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import calibration as C
from ..sources import proxies as P
from .registry import query

_SAMPLES = f"(SELECT track_id AS scene, row_number() OVER (PARTITION BY track_id ORDER BY t, event_id) - 1 AS sample, t, event_id % 3 = 0 AS accepted, x + 100 AS hx, z / 10 AS cx, event_id % 11 <> 5 AS moved FROM {P.POINTS})"


def samples(spark, sf):
    w = Window.partitionBy("track_id").orderBy("t", "event_id")
    p = P.points(spark, sf)
    return p.select(F.col("track_id").alias("scene"), (F.row_number().over(w) - 1).cast("long").alias("sample"), "t", (F.col("event_id") % 3 == 0).alias("accepted"), (F.col("x") + 100).alias("hx"), (F.col("z") / 10).alias("cx"), (F.col("event_id") % 11 != 5).alias("moved"))


def moved(d):
    return F.array(*(F.lit(v) for v in (1.0, 0.0)), d, *(F.lit(v) for v in (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)))


def _borrow_sql(missing: str, crossed: str, x: str, ends: tuple[str, str], alpha: str) -> str:
    return f"""WITH r AS (SELECT *, sum((NOT moved)::INT) OVER (PARTITION BY scene ORDER BY sample) AS breaks FROM {_SAMPLES}),
  n AS (SELECT *, max(sample) FILTER (accepted) OVER (PARTITION BY scene ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pa, min(sample) FILTER (accepted) OVER (PARTITION BY scene ORDER BY sample ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS pb FROM r),
  j AS (SELECT n.*, a.t AS at_, a.breaks AS ab, a.hx - a.cx AS ax, b.t AS bt, b.breaks AS bb, b.hx - b.cx AS bx, CASE WHEN b.t - a.t > 1e-9 THEN (n.t - a.t) / (b.t - a.t) ELSE 0.5 END AS mid FROM n LEFT JOIN r a ON a.scene = n.scene AND a.sample = pa LEFT JOIN r b ON b.scene = n.scene AND b.sample = pb WHERE NOT n.accepted),
  v AS (SELECT *, coalesce({missing}, CASE WHEN {crossed} THEN 'camera-boundary' ELSE 'borrowed' END) AS reason FROM j)
  SELECT scene, sample, reason, CASE WHEN reason = 'borrowed' THEN {ends[0]} ELSE -1 END AS from_sample, CASE WHEN reason = 'borrowed' THEN {ends[1]} ELSE -1 END AS to_sample, round(CASE WHEN reason = 'borrowed' THEN {alpha} ELSE -1 END, 6) AS alpha, round(CASE WHEN reason = 'borrowed' THEN {x} + cx ELSE -1 END, 6) AS move FROM v"""


def _borrowed(spark, sf, source):
    s = samples(spark, sf).select("scene", "sample", "t", "accepted", moved(F.col("hx")).alias("h"), moved(F.col("cx")).alias("camera"), F.when(F.col("moved"), "estimated").alias("motion"))
    out = C.borrowed(s, source)
    told = lambda c: F.coalesce(c, F.lit(-1))
    return out.select("scene", "sample", "reason", told(F.col("from_sample")).alias("from_sample"), told(F.col("to_sample")).alias("to_sample"), F.round(F.coalesce("alpha", F.lit(-1.0)), 6).alias("alpha"), F.round(F.coalesce(F.get("h", F.lit(2)), F.lit(-1.0)), 6).alias("move"))


@query(_borrow_sql("CASE WHEN pa IS NULL THEN 'no-previous' WHEN pb IS NULL THEN 'no-next' END", "ab <> bb", "ax + (bx - ax) * mid", ("pa", "pb"), "mid"))
def interpolated_calibrations(spark, sf):
    return _borrowed(spark, sf, "interpolation")


@query(_borrow_sql("CASE WHEN pa IS NULL THEN 'no-previous' END", "ab <> breaks", "ax", ("pa", "-1"), "0.0::DOUBLE"))
def previous_calibrations(spark, sf):
    return _borrowed(spark, sf, "previous")


@query(f"""WITH s AS (SELECT *, floor(hx / 20) AS x FROM {_SAMPLES}), n AS (SELECT *, max(sample) FILTER (accepted) OVER (PARTITION BY scene ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pa, min(sample) FILTER (accepted) OVER (PARTITION BY scene ORDER BY sample ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS pb FROM s),
  j AS (SELECT n.scene, n.sample, pa, pb, a.x AS ax, b.x AS bx, (n.t - a.t) / (b.t - a.t) AS p FROM n JOIN s a ON a.scene = n.scene AND a.sample = pa JOIN s b ON b.scene = n.scene AND b.sample = pb WHERE NOT n.accepted AND b.t - a.t > 1e-9)
  SELECT scene, sample, pa AS earlier, pb AS later, round(p * p * (3 - 2 * p), 6) AS weight, 30 AS valid, round(ax + (bx - ax) * p * p * (3 - 2 * p), 4) + 0 AS move FROM j WHERE abs(ax - bx) <= 2.5""")
def consensus_calibrations(spark, sf):
    s = samples(spark, sf).withColumn("x", F.floor(F.col("hx") / 20).cast("double"))
    here = F.when(F.col("accepted"), F.struct("sample", "t", "x"))
    w = Window.partitionBy("scene").orderBy("sample")
    near = s.withColumns({"a": F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "b": F.first(here, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))}).where(~F.col("accepted"))
    side = lambda c, forward: near.where(F.col(c).isNotNull()).select("scene", "sample", F.col(f"{c}.sample").alias("anchor"), F.lit(forward).alias("forward"), F.abs(F.col("t") - F.col(f"{c}.t")).alias("distance"), F.lit(0.9).alias("score"), moved(F.col(f"{c}.x")).alias("h"))
    out = C.consensus(side("a", True).unionByName(side("b", False)), s)
    return out.select("scene", "sample", "earlier", "later", F.round("weight", 6).alias("weight"), "valid", (F.round(F.get("h", F.lit(2)), 4) + 0).alias("move"))
