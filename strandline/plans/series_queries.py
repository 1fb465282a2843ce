"""Queries of the ordered-series operators over ``points`` and ``assign_rows``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from ..sources import proxies as P
from .registry import query

VALID = f"(SELECT * FROM {P.POINTS} WHERE observed AND conf <> 0 AND isfinite(x) AND isfinite(z))"
W = "(PARTITION BY track_id ORDER BY t, event_id)"
SPEED = f"""(SELECT event_id, track_id, t, d / dt AS speed FROM (SELECT event_id, track_id, t, t - lag(t) OVER {W} AS dt,
  sqrt((x - lag(x) OVER {W}) * (x - lag(x) OVER {W}) + (z - lag(z) OVER {W}) * (z - lag(z) OVER {W})) AS d FROM {VALID}) WHERE dt > 1e-6)"""
CADENCE = f"""(SELECT track_id, median(d) AS cadence, quantile_cont(CASE WHEN d > 1e-6 AND d <= 1 THEN d END, 0.25) AS short_cadence
  FROM (SELECT track_id, t - lag(t) OVER (PARTITION BY track_id ORDER BY t) AS d FROM (SELECT DISTINCT track_id, t FROM {P.POINTS})) WHERE d > 0 GROUP BY 1)"""


def islands_sql(source: str, flag: str, by: str) -> str:
    w = f"(PARTITION BY {by} ORDER BY t, event_id)"
    return f"""(SELECT *, sum(change_) OVER {w[:-1]} ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *,
  CASE WHEN row_number() OVER {w} > 1 AND {flag} IS NOT DISTINCT FROM lag({flag}) OVER {w} THEN 0 ELSE 1 END AS change_ FROM {source}))"""


@query(f"""SELECT track_id, count(*) AS n_edges, round(avg((speed > 100)::INT::DOUBLE), 6) AS ratio, round(quantile_cont(speed, 0.95), 6) AS p95, round(max(speed), 6) AS top,
  CASE WHEN avg((speed > 100)::INT::DOUBLE) IS NULL THEN 'unknown' WHEN avg((speed > 100)::INT::DOUBLE) <= 0.02 THEN 'pass' WHEN avg((speed > 100)::INT::DOUBLE) <= 0.05 THEN 'review' ELSE 'reject' END AS verdict
  FROM {SPEED} GROUP BY track_id""")
def flagship_motion_quality(spark, sf):
    q = S.motion_quality(P.points(spark, sf))
    return q.select("track_id", "n_edges", F.round("ratio", 6).alias("ratio"), F.round("p95", 6).alias("p95"), F.round("top", 6).alias("top"), "verdict")


@query(f"SELECT event_id, track_id, round(speed, 6) AS speed FROM {SPEED}")
def adjacent_speed(spark, sf):
    return S.adjacent_speed(P.points(spark, sf)).select("event_id", "track_id", F.round("speed", 6).alias("speed"))


@query(f"""SELECT event_id, track_id, round(sqrt(ax * ax + az * az) / ((d1 + d2) / 2), 6) AS acceleration FROM (
  SELECT *, (x - x1) / d1 - (x1 - x2) / d2 AS ax, (z - z1) / d1 - (z1 - z2) / d2 AS az FROM (
    SELECT event_id, track_id, x, z, t - lag(t) OVER {W} AS d1, lag(t) OVER {W} - lag(t, 2) OVER {W} AS d2, lag(x) OVER {W} AS x1, lag(x, 2) OVER {W} AS x2,
      lag(z) OVER {W} AS z1, lag(z, 2) OVER {W} AS z2 FROM {VALID}) WHERE d1 > 1e-6 AND d2 > 1e-6)""")
def acceleration_triples(spark, sf):
    return S.accelerations(P.points(spark, sf)).select("event_id", "track_id", F.round("acceleration", 6).alias("acceleration"))


@query(f"SELECT track_id, round(cadence, 6) AS cadence, round(short_cadence, 6) AS short_cadence FROM {CADENCE}")
def sample_cadence(spark, sf):
    return S.cadences(P.points(spark, sf)).select("track_id", F.round("cadence", 6).alias("cadence"), F.round("short_cadence", 6).alias("short_cadence"))


@query(f"""SELECT track_id, n, gaps, expected, round(least(1.0, n / expected), 6) AS completeness FROM (
  SELECT p.track_id, count(*) AS n, count(*) FILTER (d > greatest(0.6, 2.5 * cadence)) AS gaps, greatest(1, round_even((max(t) - min(t)) / nullif(any_value(cadence), 0), 0)::BIGINT + 1) AS expected
  FROM (SELECT *, t - lag(t) OVER {W} AS d FROM {P.POINTS}) p LEFT JOIN {CADENCE} c USING (track_id) GROUP BY p.track_id)""")
def continuity_by_track(spark, sf):
    return S.continuity(P.points(spark, sf)).select("track_id", "n", "gaps", "expected", F.round("completeness", 6).alias("completeness"))


@query(f"""SELECT track_id, round(CASE WHEN span IS NULL THEN 0.0 ELSE span + coalesce(cadence, 0.0) END, 6) AS longest FROM (
  SELECT track_id, max(span) FILTER (NOT ok) AS span FROM (SELECT track_id, island, ok, max(t) - min(t) AS span FROM {islands_sql(f"(SELECT *, observed AND conf > 0 AS ok FROM {P.POINTS})", "ok", "track_id")} GROUP BY ALL) GROUP BY 1)
  LEFT JOIN {CADENCE} USING (track_id)""")
def longest_invalid_run(spark, sf):
    return S.longest_invalid_run(P.points(spark, sf)).select("track_id", F.round("longest", 6).alias("longest"))


@query(f"SELECT track_id, round(greatest(coalesce(max(d), 0.0), min(t) - 0.0, 720.0 - max(t)), 6) AS max_gap FROM (SELECT *, t - lag(t) OVER {W} AS d FROM {VALID}) GROUP BY 1")
def edge_max_gap(spark, sf):
    return S.edge_max_gap(P.points(spark, sf), 0.0, 720.0).select("track_id", F.round("max_gap", 6).alias("max_gap"))


@query(f"""SELECT event_id, track_id, CASE WHEN a IS NULL OR b IS NULL THEN x ELSE round((a + 2 * x + b) / 4, 6) END AS sx, CASE WHEN a IS NULL OR b IS NULL THEN z ELSE round((c + 2 * z + d) / 4, 6) END AS sz FROM (
  SELECT *, lag(x) OVER {W} AS a, lead(x) OVER {W} AS b, lag(z) OVER {W} AS c, lead(z) OVER {W} AS d FROM {P.POINTS})""")
def smooth_121(spark, sf):
    return S.smooth_121(P.points(spark, sf)).select("event_id", "track_id", F.round("sx", 6).alias("sx"), F.round("sz", 6).alias("sz"))


@query(f"""SELECT track_id, chain, n, round(start, 6) AS start, breaks FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, chain) AS k FROM (
  SELECT track_id, chain, count(*) AS n, min(t) AS start, sum((speed > 14)::INT)::BIGINT AS breaks FROM (
    SELECT *, (sum((speed > 25)::INT) OVER {W[:-1]} ROWS UNBOUNDED PRECEDING))::BIGINT AS chain FROM (
      SELECT *, CASE WHEN lag(t) OVER {W} IS NULL THEN 0.0 ELSE greatest(0.0, sqrt((x - lag(x) OVER {W}) * (x - lag(x) OVER {W}) + (z - lag(z) OVER {W}) * (z - lag(z) OVER {W}))
        - least(2.5, ((1 - conf) + lag(1 - conf) OVER {W}) / 2)) / greatest(0.001, t - lag(t) OVER {W}) END AS speed FROM {VALID})) GROUP BY ALL)) WHERE k = 1""")
def splice_chains(spark, sf):
    return S.splice_chains(P.points(spark, sf)).select("track_id", "chain", "n", F.round("start", 6).alias("start"), "breaks")


FILL = S.FillConfig(least_step=2.0, most_step=6.0, least_gap=12.0)


@query(f"""SELECT event_id, track_id, k, round(t + k * step, 6) AS t, round(x + (x2 - x) * (k * step / d), 6) AS x, round(z + (z2 - z) * (k * step / d), 6) AS z,
    round(least(18.0, greatest(1 - conf, 1 - conf2) + 1 + 0.8::DOUBLE * d), 6) AS uncertainty FROM (
  SELECT *, unnest(generate_series(1, n)) AS k FROM (SELECT *, ceil((d - 1e-6) / step)::INT - 1 AS n FROM (
    SELECT p.*, t2 - t AS d, least(6.0, greatest(2.0, 2 * coalesce(cadence, 0.2))) AS step, greatest(12.0, 2.5 * coalesce(cadence, 0.2)) AS gap
    FROM (SELECT *, lead(t) OVER {W} AS t2, lead(x) OVER {W} AS x2, lead(z) OVER {W} AS z2, lead(conf) OVER {W} AS conf2 FROM {P.POINTS}) p JOIN {CADENCE} c USING (track_id)) WHERE d > gap) WHERE n > 0)""")
def gap_fill_linear(spark, sf):
    return S.gap_fill(P.points(spark, sf), FILL).select("event_id", "track_id", "k", *[F.round(c, 6).alias(c) for c in ("t", "x", "z", "uncertainty")])


NAMED = f"(SELECT * FROM {P.ASSIGN_ROWS} WHERE pred IS NOT NULL)"


@query(f"""SELECT seq, count(*) AS stable_runs, coalesce(sum(switch), 0)::BIGINT AS switches FROM (SELECT seq, (lead(pred) OVER (PARTITION BY seq ORDER BY island) <> pred)::INT AS switch FROM (
  SELECT seq, island, pred, count(*) AS n FROM {islands_sql(NAMED, "pred", "seq")} GROUP BY ALL) WHERE n >= 3) GROUP BY seq""")
def stable_run_switch(spark, sf):
    return S.stable_run_switch(P.assign_rows(spark, sf))


@query(f"SELECT seq, island::BIGINT AS island, any_value(pred) AS pred, count(*) AS n FROM {islands_sql(P.ASSIGN_ROWS, 'pred', 'seq')} GROUP BY seq, island")
def run_length_code(spark, sf):
    return S.run_lengths(P.assign_rows(spark, sf))


@query(f"""SELECT gt, count(*) FILTER (pred <> known) AS switches, count(*) FILTER (pred IS NOT NULL AND before IS NULL AND known IS NOT NULL) AS fragments FROM (
  SELECT *, last_value(pred IGNORE NULLS) OVER (PARTITION BY gt ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known, lag(pred) OVER (PARTITION BY gt ORDER BY t, event_id) AS before FROM {P.ASSIGN_ROWS}) GROUP BY gt""")
def id_switches_fragments(spark, sf):
    return S.switches_and_fragments(P.assign_rows(spark, sf))


@query(f"""SELECT event_id, track_id, CASE WHEN observed THEN 'observed' WHEN b - a <= 12 THEN 'inferred' ELSE 'occluded' END AS state FROM (
  SELECT *, last_value(CASE WHEN observed THEN t END IGNORE NULLS) OVER {W[:-1]} ROWS UNBOUNDED PRECEDING) AS a,
    first_value(CASE WHEN observed THEN t END IGNORE NULLS) OVER {W[:-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM {P.POINTS})""")
def state_labels(spark, sf):
    return S.state_labels(P.points(spark, sf))


@query(f"SELECT track_id, count(*) AS runs, max(n) AS longest, sum(n)::BIGINT AS points FROM (SELECT track_id, island, count(*) AS n FROM {islands_sql(P.POINTS, 'observed', 'track_id')} WHERE NOT observed GROUP BY ALL) GROUP BY 1")
def gap_statistics(spark, sf):
    return S.gap_statistics(P.points(spark, sf))


@query(f"""WITH p AS {P.POINTS}, q AS (SELECT DISTINCT track_id, unnest(generate_series(0, 720, 24))::DOUBLE AS q FROM p),
  a AS (SELECT q.track_id, q, max_by(struct_pack(t := t, x := x, z := z), struct_pack(t := t, e := event_id)) AS a FROM q JOIN p ON p.track_id = q.track_id AND t <= q GROUP BY ALL),
  b AS (SELECT q.track_id, q, min_by(struct_pack(t := t, x := x, z := z), struct_pack(t := t, e := event_id)) AS b FROM q JOIN p ON p.track_id = q.track_id AND t > q GROUP BY ALL)
  SELECT track_id, q, round(CASE WHEN a IS NULL THEN b.x WHEN b IS NULL THEN a.x ELSE a.x + (b.x - a.x) * ((q - a.t) / (b.t - a.t)) END, 6) AS x,
    round(CASE WHEN a IS NULL THEN b.z WHEN b IS NULL THEN a.z ELSE a.z + (b.z - a.z) * ((q - a.t) / (b.t - a.t)) END, 6) AS z FROM q LEFT JOIN a USING (track_id, q) LEFT JOIN b USING (track_id, q)""")
def interpolate_at(spark, sf):
    times = spark.range(31).select((F.col("id") * 24).cast("double").alias("q"))
    return S.interpolate_at(P.points(spark, sf), times).select("track_id", "q", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))


@query(f"""SELECT track_id, segment::BIGINT AS segment, any_value(observed) AS observed, count(*) AS n, round(min(t), 6) AS t_start, round(max(t), 6) AS t_end FROM (
  SELECT *, sum(change) OVER {W[:-1]} ROWS UNBOUNDED PRECEDING) AS segment FROM (SELECT *, CASE WHEN lag(t) OVER {W} IS NULL
    OR sqrt((x - lag(x) OVER {W}) * (x - lag(x) OVER {W}) + (z - lag(z) OVER {W}) * (z - lag(z) OVER {W})) > 60 OR lag(observed) OVER {W} <> observed THEN 1 ELSE 0 END AS change FROM {P.POINTS})) GROUP BY track_id, segment""")
def path_segments(spark, sf):
    return S.path_segments(P.points(spark, sf)).select("track_id", "segment", "observed", "n", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"))


@query(f"""SELECT track_id, count(*) FILTER (observed) AS n_observed, count(*) FILTER (NOT observed) AS n_hidden, round(min(t), 6) AS first_t, round(max(t), 6) AS last_t,
  round(min(t) FILTER (observed), 6) AS first_seen, round(max(t) FILTER (observed), 6) AS last_seen FROM {P.POINTS} GROUP BY 1""")
def presence_summary(spark, sf):
    out = S.presence_summary(P.points(spark, sf))
    return out.select("track_id", "n_observed", "n_hidden", *[F.round(c, 6).alias(c) for c in ("first_t", "last_t", "first_seen", "last_seen")])


@query(f"""WITH k AS (SELECT *, floor(t * 10 + 0.5) / 10 AS rt, kind = 'signup' AS by_hand FROM {P.POINTS}),
  one AS (SELECT *, row_number() OVER (PARTITION BY track_id, rt, by_hand ORDER BY event_id) AS n FROM k),
  a AS (SELECT track_id, rt, x FROM one WHERE n = 1 AND NOT by_hand), m AS (SELECT track_id, rt, x FROM one WHERE n = 1 AND by_hand)
  SELECT track_id, rt, coalesce(m.x, a.x) AS x, CASE WHEN m.rt IS NOT NULL THEN 'manual' ELSE 'automatic' END AS origin FROM a FULL JOIN m USING (track_id, rt)""".replace("m.rt IS NOT NULL", "m.x IS NOT NULL"))
def manual_overlay(spark, sf):
    p = P.points(spark, sf)
    return S.overlay(p.where("kind <> 'signup'"), p.where("kind = 'signup'"))


@query(f"""SELECT event_id, round(CASE WHEN t < 0 THEN 0.0 WHEN t < 100 THEN 0 + (t - 0) * (90.0::DOUBLE / 100) WHEN t < 300 THEN 90 + (t - 100) * (220.0::DOUBLE / 200) WHEN t < 720 THEN 310 + (t - 300) * (390.0::DOUBLE / 420) ELSE 700.0 END, 6) AS clock FROM {P.POINTS}""")
def clock_map(spark, sf):
    return S.clock_map(P.points(spark, sf), [(0.0, 0.0), (100.0, 90.0), (300.0, 310.0), (720.0, 700.0)]).select("event_id", F.round("clock", 6).alias("clock"))


@query()
def debounced_segments(spark, sf):
    cuts = P.points(spark, sf).where("kind = 'click'").select(F.col("track_id").alias("owner"), "t")
    out = S.cuts_to_segments(cuts, 0.0, 720.0, 6.0, 12.0)
    return out.select("owner", F.col("segment").cast("long").alias("segment"), F.round("s", 6).alias("s"), F.round("e", 6).alias("e"))


@query("SELECT o_orderkey AS id, CASE WHEN i < 26 THEN chr((65 + i)::INT) ELSE chr((64 + i // 26)::INT) || chr((65 + i % 26)::INT) END AS letters FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders)")
def variant_letters(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return P.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), S.variant_letters(n).alias("letters"))
