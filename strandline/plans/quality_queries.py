"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assign as A
from ..operators import blocks as B
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import series as S
from ..sources import proxies as P
from .join_queries import _IOU, _PAIRS, _candidates
from .registry import query
from .series_queries import SPEED

_RUN = f"""(SELECT *, tp / rank AS precision, tp / nullif(positives, 0) AS recall, max(tp / rank) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM (
  SELECT id, truth, row_number() OVER (ORDER BY score DESC, id) AS rank, sum(truth) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS tp, sum(truth) OVER () AS positives FROM {P.LABELLED}))"""


@query(f"SELECT id, truth, rank, tp::BIGINT AS tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(envelope, 6) AS envelope FROM {_RUN}")
def cumulative_precision_recall(spark, sf):
    return Q.precision_recall(P.labelled(spark, sf)).select("id", "truth", "rank", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "envelope")])


@query(f"SELECT round(sum(CASE WHEN truth = 1 THEN envelope END) / max(positives), 6) AS average_precision, count(*) AS n FROM {_RUN}")
def average_precision(spark, sf):
    return Q.average_precision(P.labelled(spark, sf)).withColumn("average_precision", F.round("average_precision", 6))


@query(f"SELECT truth, count(*) FILTER (guess = 0) AS as_0, count(*) FILTER (guess = 1) AS as_1, count(*) AS n FROM (SELECT truth, (score > 1000)::INT AS guess FROM {P.LABELLED}) GROUP BY truth")
def classification_confusion(spark, sf):
    return Q.confusion(P.labelled(spark, sf), F.col("truth"), (F.col("score") > 1000).cast("int"), [0, 1])


@query("""SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95,
  round(sqrt(avg(l_extendedprice * l_extendedprice)), 4) AS rmse, max(l_extendedprice) AS top FROM lineitem GROUP BY 1""")
def distribution_summary(spark, sf):
    out = Q.distribution(P.read(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "p95", "rmse")], "top")


@query("""SELECT l_linenumber, round(quantile_cont(l_quantity, 0.05), 6) AS p05, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.95), 6) AS p95 FROM lineitem GROUP BY 1""")
def percentile_grid(spark, sf):
    out = Q.percentile_grid(P.read(spark, sf, "lineitem"), ["l_linenumber"], "l_quantity")
    return out.select("l_linenumber", *[F.round(c, 6).alias(c) for c in ("p05", "p50", "p95")])


@query()
def detection_prf(spark, sf):
    matches = A.optimal_matches(_candidates(spark, sf), "frame", "g_id", "p_id", "iou")
    return Q.detection_scores(J.frame_outer(P.boxes(spark, sf)), matches)


@query(f"""WITH f AS (SELECT count(*) FILTER (side = 'gt') AS gt, count(*) FILTER (side = 'pred') AS pred FROM {P.BOXES}),
  c AS (SELECT frame, g_id, p_id, round(iou, 9) AS iou FROM {_IOU} WHERE iou > 0.5),
  m AS (SELECT count(*) AS tp FROM (SELECT *, row_number() OVER (PARTITION BY frame, g_id ORDER BY iou DESC, g_id, p_id) AS a, row_number() OVER (PARTITION BY frame, p_id ORDER BY iou DESC, g_id, p_id) AS b FROM c) WHERE a = 1 AND b = 1)
  SELECT tp, pred - tp AS fp, gt - tp AS fn, round(tp / pred, 6) AS precision, round(tp / gt, 6) AS recall, round(2 * (tp / pred) * (tp / gt) / (tp / pred + tp / gt), 6) AS f1 FROM f, m""")
def detection_prf_mutual(spark, sf):
    matches = A.mutual_best(_candidates(spark, sf), "frame", "g_id", "p_id", "iou")
    out = Q.detection_scores(J.frame_outer(P.boxes(spark, sf)), matches)
    return out.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_BALL = f"""(SELECT frame, max(x) FILTER (side = 'gt') AS gx, max(y) FILTER (side = 'gt') AS gy, max(x) FILTER (side = 'pred') AS px, max(y) FILTER (side = 'pred') AS py FROM {P.BOXES} GROUP BY frame)"""


@query(f"""SELECT count(*) FILTER (d <= 12) AS hits, count(*) FILTER (px IS NOT NULL AND NOT coalesce(d <= 12, false)) AS false_positives, count(*) FILTER (gx IS NOT NULL AND NOT coalesce(d <= 12, false)) AS misses,
  round(avg(d) FILTER (d <= 12), 6) AS mean_error FROM (SELECT *, sqrt((gx - px) * (gx - px) + (gy - py) * (gy - py)) AS d FROM {_BALL})""")
def localisation_error(spark, sf):
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    rows = P.boxes(spark, sf).groupBy("frame").agg(side("gt", "x").alias("gx"), side("gt", "y").alias("gy"), side("pred", "x").alias("px"), side("pred", "y").alias("py"))
    return Q.localisation(rows, 12.0).withColumn("mean_error", F.round("mean_error", 6))


@query(f"SELECT seq, gt, pred, count(*) AS count FROM (SELECT DISTINCT seq, t, gt, pred FROM {P.ASSIGN_ROWS} WHERE pred IS NOT NULL) GROUP BY ALL")
def contingency_counts(spark, sf):
    return Q.contingency(P.assign_rows(spark, sf))


@query(f"""WITH k AS (SELECT DISTINCT seq, t, gt, pred FROM {P.ASSIGN_ROWS}), b AS (SELECT DISTINCT seq FROM (SELECT seq, t, gt, count(DISTINCT pred) AS n FROM k GROUP BY ALL) WHERE n > 1),
  c AS (SELECT seq, pred, count(*) AS n FROM k GROUP BY ALL), s AS (SELECT seq, sum(n) AS gt, coalesce(sum(n) FILTER (pred IS NOT NULL), 0) AS pred, coalesce(max(n) FILTER (pred IS NOT NULL), 0) AS tp FROM c GROUP BY seq)
  SELECT s.seq, tp AS idtp, (pred - tp)::BIGINT AS idfp, (gt - tp)::BIGINT AS idfn, CASE WHEN b.seq IS NULL THEN round(2 * tp / (gt + pred), 6) END AS idf1, CASE WHEN b.seq IS NULL THEN 'valid' ELSE 'invalid' END AS status FROM s LEFT JOIN b USING (seq)""")
def contingency_idf1(spark, sf):
    # One ground truth per sequence here, so the best map is the most frequent prediction.
    return Q.identity_f1(P.assign_rows(spark, sf)).withColumn("idf1", F.round("idf1", 6))


@query()
def same_diff_distance_whole(spark, sf):
    # All pairs; distances are counted at six decimals. The sampled query above keeps its SQL.
    rows = Q.pair_distances(P.vectors(spark, sf))
    return rows.groupBy("same").agg(*[F.round(F.percentile("d", F.lit(q), F.col("n")), 6).alias(n) for n, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))], F.sum("n").alias("n"))


@query(f"""WITH p AS (SELECT person, pred, succ, greatest(0.0, 1 - sim) AS d FROM {_PAIRS}), b AS (SELECT person, pred AS id, d FROM p UNION ALL SELECT person, succ, d FROM p),
  n AS (SELECT person, id, min(d) AS d FROM b GROUP BY ALL) SELECT person, round(median(d), 6) AS robust, round(min(d), 6) AS least, count(*) AS n FROM n GROUP BY person""")
def robust_bidirectional_distance(spark, sf):
    near = B.nearest(P.vectors(spark, sf), "person")
    return near.groupBy("person").agg(F.round(F.median("d"), 6).alias("robust"), F.round(F.min("d"), 6).alias("least"), F.count("*").alias("n"))


@query(f"""SELECT CASE WHEN h < 30 THEN 'low' WHEN h < 60 THEN 'mid' ELSE 'high' END AS stratum, side, count(*) AS n FROM (SELECT side, x + y AS h FROM {P.BOXES}) GROUP BY ALL""")
def height_strata(spark, sf):
    h = F.col("x") + F.col("y")
    return P.boxes(spark, sf).groupBy(F.when(h < 30, "low").when(h < 60, "mid").otherwise("high").alias("stratum"), "side").agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT avg((speed > 100)::INT::DOUBLE) AS ratio, quantile_cont(speed, 0.95) AS p95 FROM {SPEED}), o AS (SELECT avg(observed::INT::DOUBLE) AS seen FROM {P.POINTS})
  SELECT gate, round(value, 6) AS value, verdict FROM (
  SELECT 'speed_ratio' AS gate, ratio AS value, CASE WHEN ratio <= 0.02 THEN 'pass' WHEN ratio <= 0.06 THEN 'review' ELSE 'reject' END AS verdict FROM s
  UNION ALL SELECT 'speed_p95', p95, CASE WHEN p95 <= 100 THEN 'pass' WHEN p95 <= 200 THEN 'review' ELSE 'reject' END FROM s
  UNION ALL SELECT 'observed', seen, CASE WHEN seen >= 0.9 THEN 'pass' WHEN seen >= 0.7 THEN 'review' ELSE 'reject' END FROM o)""")
def gate_report(spark, sf):
    p = P.points(spark, sf)
    speed = S.adjacent_speed(p).agg(F.avg((F.col("speed") > 100).cast("double")).alias("ratio"), F.percentile("speed", F.lit(0.95)).alias("p95"))
    values = speed.crossJoin(p.agg(F.avg(F.col("observed").cast("double")).alias("seen")))  # one row each
    out = Q.gates(values, [("speed_ratio", "ratio", False, 0.02, 0.06), ("speed_p95", "p95", False, 100.0, 200.0), ("observed", "seen", True, 0.9, 0.7)])
    return out.select("gate", F.round("value", 6).alias("value"), "verdict")


@query(f"SELECT n, count(*) AS tracks FROM (SELECT track_id, count(*) AS n FROM {P.POINTS} GROUP BY 1) GROUP BY n")
def track_length_histogram(spark, sf):
    return P.points(spark, sf).groupBy("track_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("tracks"))


@query("""WITH r AS (SELECT l_suppkey * 1000 + l_orderkey % 50 AS person, CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS truth, CASE WHEN l_discount > 0.02 THEN (l_partkey % 7 + 1)::INT END AS number FROM lineitem),
  p AS (SELECT count(*) FILTER (k > 1) AS conflicts, count(*) AS read_persons FROM (SELECT person, count(DISTINCT number) AS k FROM r WHERE number IS NOT NULL GROUP BY 1)),
  s AS (SELECT count(*) FILTER (truth IS NOT NULL) AS readable, count(*) FILTER (number = truth) AS exact, count(*) FILTER (number <> truth) AS substituted, count(*) FILTER (truth IS NOT NULL AND number IS NULL) AS abstained, count(*) FILTER (truth IS NULL AND number IS NOT NULL) AS invented FROM r)
  SELECT *, round(exact / readable, 6) AS exact_rate, round(substituted / readable, 6) AS substitution_rate, round(abstained / readable, 6) AS abstention_rate, round(conflicts / read_persons, 6) AS conflict_rate FROM s, p""")
def number_reading(spark, sf):
    line = P.read(spark, sf, "lineitem")
    rows = line.select((F.col("l_suppkey") * 1000 + F.col("l_orderkey") % 50).alias("person"), F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")).alias("truth"), F.when(F.col("l_discount") > 0.02, (F.col("l_partkey") % 7 + 1).cast("int")).alias("number"))
    out = Q.number_reading(rows)
    return out.select(*[c for c in out.columns if not c.endswith("_rate")], *[F.round(c, 6).alias(c) for c in out.columns if c.endswith("_rate")])


@query(f"""WITH s AS (SELECT avg((speed > 100)::INT::DOUBLE) AS ratio, quantile_cont(speed, 0.95) AS p95 FROM {SPEED}), o AS (SELECT avg(observed::INT::DOUBLE) AS seen FROM {P.POINTS}),
  v AS (SELECT CASE WHEN ratio <= 0.02 THEN 'pass' WHEN ratio <= 0.06 THEN 'review' ELSE 'reject' END AS a, CASE WHEN p95 <= 100 THEN 'pass' WHEN p95 <= 200 THEN 'review' ELSE 'reject' END AS b, CASE WHEN seen >= 0.9 THEN 'pass' WHEN seen >= 0.7 THEN 'review' ELSE 'reject' END AS c FROM s, o)
  SELECT CASE WHEN 'reject' IN (a, c) THEN 'reject' WHEN 'review' IN (a, c) THEN 'review' ELSE 'pass' END AS verdict, '{{"observed":"' || c || '","speed_p95":"' || b || '","speed_ratio":"' || a || '"}}' AS gates FROM v""")
def quality_report(spark, sf):
    p = P.points(spark, sf)
    speed = S.adjacent_speed(p).agg(F.avg((F.col("speed") > 100).cast("double")).alias("ratio"), F.percentile("speed", F.lit(0.95)).alias("p95"))
    values = speed.crossJoin(p.agg(F.avg(F.col("observed").cast("double")).alias("seen")))  # one row each
    return Q.report(values, [("speed_ratio", "ratio", False, 0.02, 0.06), ("speed_p95", "p95", False, 100.0, 200.0), ("observed", "seen", True, 0.9, 0.7)], ["speed_ratio", "observed"])
