"""Queries of record contracts, waiting jobs, manifests and timelines over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as C
from ..sources import proxies as P
from .registry import query

_KNOWN = ", ".join(f"'{a}'" for a in C.ACTIONS)
_KINDS = "['run', 'pass', 'shot', 'dance', 'block', 'feint']"
_KEYS = "[{'kind': CASE WHEN l_suppkey % 6 = 0 THEN 'nothing' ELSE 'contact' END, 'time': l_quantity + 0.5}, {'kind': 'apex', 'time': l_quantity + l_linenumber - 1}]"


@query(f"""WITH a AS (SELECT 'a' || l_orderkey % 900 || '.' || l_linenumber || CASE WHEN l_suppkey % 7 = 0 THEN ' ' ELSE '' END AS id, l_suppkey AS person, {_KINDS}[l_partkey % 6 + 1] AS type, CASE WHEN l_partkey % 11 = 0 THEN -1.0 ELSE l_quantity END AS start, l_quantity + l_linenumber - 1 AS stop, {_KEYS} AS k FROM lineitem),
  p AS (SELECT s_suppkey AS person, 20.0 + s_suppkey % 30 AS scene_end FROM supplier WHERE s_suppkey % 4 > 0), r AS (SELECT a.*, scene_end, count(*) OVER (PARTITION BY id) > 1 AS twice FROM a LEFT JOIN p USING (person)),
  i AS (SELECT *, len(list_filter(k, lambda x: x.time >= start AND x.time <= stop)) = 2 AS inside FROM r)
  SELECT id, concat_ws(',', CASE WHEN id LIKE '% ' THEN 'bad-id' END, CASE WHEN twice THEN 'duplicate-id' END, CASE WHEN scene_end IS NULL THEN 'unknown-person' END, CASE WHEN type NOT IN ({_KNOWN}) THEN 'unknown-type' END, CASE WHEN start < 0 THEN 'bad-start' END, CASE WHEN stop <= start THEN 'bad-stop' END,
    CASE WHEN stop > scene_end THEN 'after-scene' END, CASE WHEN k[1].kind = 'nothing' THEN 'unknown-keypoint' END, CASE WHEN NOT inside THEN 'keypoint-outside' END, CASE WHEN inside AND k[1].time > k[2].time THEN 'keypoints-unordered' END) AS problems FROM i""")
def player_action_problems(spark, sf):
    e = {
        "id": "concat('a', l_orderkey % 900, '.', l_linenumber, if(l_suppkey % 7 = 0, ' ', ''))", "person": "l_suppkey", "type": "element_at(array('run', 'pass', 'shot', 'dance', 'block', 'feint'), int(l_partkey % 6 + 1))", "start": "if(l_partkey % 11 = 0, -1D, l_quantity)", "stop": "l_quantity + l_linenumber - 1",
        "keypoints": "array(named_struct('kind', if(l_suppkey % 6 = 0, 'nothing', 'contact'), 'time', l_quantity + 0.5D), named_struct('kind', 'apex', 'time', l_quantity + l_linenumber - 1))",
    }
    people = P.read(spark, sf, "supplier").where("s_suppkey % 4 > 0").selectExpr("s_suppkey AS person", "20D + s_suppkey % 30 AS duration")
    return C.action_problems(P.read(spark, sf, "lineitem").select(*(F.expr(v).alias(k) for k, v in e.items())), people).select("id", F.concat_ws(",", "problems").alias("problems"))


@query("""WITH j AS (SELECT o_orderkey AS job, CASE o_orderkey % 9 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'cancelled' END ELSE 'ready' END AS status FROM orders),
  w AS (SELECT l_orderkey AS job, l_partkey AS child, min((l_linenumber % 2 = 0)::INT) AS optional FROM lineitem GROUP BY ALL),
  s AS (SELECT w.job, count(*) FILTER (status IN ('queued', 'processing')) AS open, count(*) FILTER (optional = 0 AND coalesce(status NOT IN ('queued', 'processing', 'ready'), true)) AS failed FROM w LEFT JOIN j ON j.job = child GROUP BY w.job)
  SELECT j.job, CASE WHEN coalesce(failed, 0) > 0 THEN 'failed' WHEN coalesce(open, 0) > 0 THEN 'waiting' ELSE 'ready' END AS state, coalesce(open, 0) AS open, coalesce(failed, 0) AS failed, CASE WHEN coalesce(failed, 0) = 0 AND coalesce(open, 0) > 0 THEN 102.5 ELSE -1 END::DOUBLE AS again FROM j LEFT JOIN s USING (job)""")
def waiting_jobs(spark, sf):
    status = "CASE o_orderkey % 9 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN if(o_orderkey % 4 = 0, 'failed', 'cancelled') ELSE 'ready' END AS status"
    jobs = P.read(spark, sf, "orders").selectExpr("o_orderkey AS job", status)
    waits = P.read(spark, sf, "lineitem").selectExpr("l_orderkey AS job", "l_partkey AS child", "l_linenumber % 2 = 0 AS optional")
    return C.waiting_jobs(jobs, waits, 100.0, 2.5).withColumn("again", F.coalesce("again", F.lit(-1.0)))


@query("""WITH s AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN ' ' ELSE 's' || c_custkey % 120 END AS sample, c_custkey % 13 - 1 AS rate FROM customer), p AS (SELECT 's' || l_orderkey AS sample, l_linenumber AS frame, CASE WHEN l_partkey % 10 > 0 THEN 'p' || l_partkey % 3 ELSE '' END AS person, l_quantity - 5 AS w, l_quantity AS h FROM lineitem),
  q AS (SELECT 's' || l_orderkey AS sample, l_linenumber AS frame, CASE WHEN l_suppkey % 9 > 0 THEN 'c' || l_suppkey % 4 END AS point FROM lineitem), g AS (SELECT sample, count(*) AS n, min(rate) AS rate FROM s GROUP BY 1)
  SELECT sample, 'sample-without-id' AS problem, '' AS detail FROM g WHERE trim(sample) = '' UNION SELECT sample, 'duplicate-sample', '' FROM g WHERE trim(sample) <> '' AND n > 1 UNION SELECT sample, 'bad-frame-rate', '' FROM g WHERE rate <= 0
  UNION SELECT sample, 'bad-box', frame || '/' || person FROM p WHERE w <= 0 OR h <= 0 UNION SELECT sample, 'person-without-id', frame::VARCHAR FROM p WHERE person = '' UNION SELECT sample, 'duplicate-person', frame || '/' || person FROM p WHERE person <> '' GROUP BY sample, frame, person HAVING count(*) > 1
  UNION SELECT sample, 'point-without-id', frame::VARCHAR FROM q WHERE point IS NULL UNION SELECT sample, 'duplicate-point', frame || '/' || point FROM q WHERE point IS NOT NULL GROUP BY sample, frame, point HAVING count(*) > 1""")
def manifest_problems(spark, sf):
    samples = P.read(spark, sf, "customer").selectExpr("if(c_custkey % 50 = 0, ' ', concat('s', c_custkey % 120)) AS sample", "c_custkey % 13 - 1 AS rate")
    lines = P.read(spark, sf, "lineitem")
    people = lines.selectExpr("concat('s', l_orderkey) AS sample", "l_linenumber AS frame", "if(l_partkey % 10 > 0, concat('p', l_partkey % 3), '') AS person", "l_quantity - 5 AS w", "l_quantity AS h")
    return C.manifest_problems(samples, people, lines.selectExpr("concat('s', l_orderkey) AS sample", "l_linenumber AS frame", "if(l_suppkey % 9 > 0, concat('c', l_suppkey % 4), null) AS point"))


@query(f"""WITH d AS (SELECT DISTINCT track_id, floor(t)::BIGINT AS frame, kind AS state FROM {P.POINTS}), b AS (SELECT *, row_number() OVER w AS k, lag(state) OVER w AS was FROM d WINDOW w AS (PARTITION BY track_id ORDER BY frame, state)),
  r AS (SELECT *, sum((was IS DISTINCT FROM state OR k = 1)::INT) OVER (PARTITION BY track_id ORDER BY frame, state) AS run FROM b)
  SELECT track_id, any_value(state) AS state, min(frame) AS first, max(frame) AS last, count(*) AS n, CASE WHEN count(*) < max(frame) - min(frame) + 1 THEN string_agg(frame::VARCHAR, ',' ORDER BY frame) ELSE '' END AS frames FROM r GROUP BY track_id, run""")
def compact_timelines(spark, sf):
    rows = P.points(spark, sf).select("track_id", F.floor("t").cast("long").alias("frame"), F.col("kind").alias("state"))
    return C.compact_timeline(rows, "track_id").withColumn("frames", F.coalesce(F.array_join(F.col("frames").cast("array<string>"), ","), F.lit("")))
