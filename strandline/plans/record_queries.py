"""Queries over records: identifiers, normalisation, audits, roll-ups and time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import records as R
from ..sources import proxies as P
from .registry import query


@query("""SELECT event_id, k, substr(sha256(user_id::VARCHAR || chr(31) || event_type || chr(31) || k::VARCHAR), 1, 16) AS id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS k FROM events)""")
def timeline_occurrence_ids(spark, sf):
    return R.occurrence_ids(P.read(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], 16).select("event_id", "k", "id")


@query("""SELECT o_orderkey, substr(sha256(r_name || chr(31) || n_name || chr(31) || c_custkey::VARCHAR || chr(31) || o_orderkey::VARCHAR), 1, 24) AS id FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def stable_ids(spark, sf):
    t = P.read(spark, sf, "orders").join(P.read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = t.join(P.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(P.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.select("o_orderkey", T.stable_id(F.col("r_name"), F.col("n_name"), F.col("c_custkey"), F.col("o_orderkey")).alias("id"))


RULES = [("commerce", ["purch", "buy"]), ("account", ["sign", "log"]), ("fault", ["err"]), ("browse", ["view", "click", "r"])]


@query("""SELECT event_id, CASE WHEN contains(e, 'purch') OR contains(e, 'buy') THEN 'commerce' WHEN contains(e, 'sign') OR contains(e, 'log') THEN 'account' WHEN contains(e, 'err') THEN 'fault'
  WHEN contains(e, 'view') OR contains(e, 'click') OR contains(e, 'r') THEN 'browse' ELSE 'other' END AS family FROM (SELECT event_id, lower(event_type) AS e FROM events)""")
def taxonomy_case(spark, sf):
    return P.read(spark, sf, "events").select("event_id", T.contains_case(F.col("event_type"), RULES, "other").alias("family"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness_violations(spark, sf):
    return R.duplicates(P.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH s AS (SELECT user_id, event_id, event_type AS after, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
  SELECT before, after, count(*) AS n FROM s WHERE before IS NOT NULL AND (before || '>' || after) NOT IN ('view>click', 'click>purchase', 'signup>view', 'view>view', 'click>view', 'purchase>view', 'error>view') GROUP BY ALL""")
def transition_audit(spark, sf):
    allowed = [("view", "click"), ("click", "purchase"), ("signup", "view"), ("view", "view"), ("click", "view"), ("purchase", "view"), ("error", "view")]
    return R.forbidden_transitions(P.read(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", allowed)


@query(f"""SELECT event_id, CASE WHEN reason <> 'outside' THEN greatest(-50.0, least(50.0, px)) END AS px, CASE WHEN reason <> 'outside' THEN greatest(-30.0, least(30.0, pz)) END AS pz, reason FROM (
  SELECT *, CASE WHEN abs(px) - 50 > 4 OR abs(pz) - 30 > 4 THEN 'outside' WHEN abs(px) <= 50 AND abs(pz) <= 30 THEN 'inside' ELSE 'clamped' END AS reason FROM (SELECT event_id, x - 5 AS px, z - 50 AS pz FROM {P.POINTS}))""")
def projection_gate(spark, sf):
    m = G.metric_projection(F.col("x") - 5, F.col("z") - 50, 100.0, 60.0)
    return P.points(spark, sf).select("event_id", m.alias("m")).select("event_id", F.col("m.x").alias("px"), F.col("m.z").alias("pz"), F.col("m.reason").alias("reason"))


@query(f"""SELECT event_id, round((1.1 * x + 0.05 * z + 3) / w, 6) AS u, round((0.02 * x + 0.9 * z - 2) / w, 6) AS v FROM (SELECT *, 0.001 * x + 0.0005 * z + 1 AS w FROM (SELECT event_id, x, z FROM {P.POINTS}))""".replace("1.1 *", "1.1::DOUBLE *").replace("0.05 *", "0.05::DOUBLE *").replace("0.02 *", "0.02::DOUBLE *").replace("0.9 *", "0.9::DOUBLE *").replace("0.001 *", "0.001::DOUBLE *").replace("0.0005 *", "0.0005::DOUBLE *"))
def homography_projection(spark, sf):
    h = F.array(*[F.lit(v) for v in (1.1, 0.05, 3.0, 0.02, 0.9, -2.0, 0.001, 0.0005, 1.0)])
    m = G.project(h, F.col("x"), F.col("z"))
    return P.points(spark, sf).select("event_id", F.round(m["x"], 6).alias("u"), F.round(m["y"], 6).alias("v"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def slug_names(spark, sf):
    return P.read(spark, sf, "customer").select("c_custkey", T.slug(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("slug"))


@query("""SELECT o_orderkey, sha256('{"customer":' || o_custkey || ',"order":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS digest FROM orders""")
def canonical_digest(spark, sf):
    o = P.read(spark, sf, "orders")
    return o.select("o_orderkey", T.digest(order=F.col("o_orderkey"), customer=F.col("o_custkey"), status=F.col("o_orderstatus")).alias("digest"))


@query("SELECT * EXCLUDE k FROM (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_per_key(spark, sf):
    return R.latest(P.read(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("""SELECT user_id, event_id FROM (SELECT *, sum(bad) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM (SELECT *, (event_type = 'error')::INT AS bad FROM events)) WHERE seen = 0""")
def valid_prefix(spark, sf):
    return R.valid_prefix(P.read(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "error").select("user_id", "event_id")


@query("""SELECT event_id, user_id, round(t, 6) AS t FROM (SELECT event_id, user_id, (epoch_us(ts) - 1704067200000000)::DOUBLE / 3.6e9::DOUBLE AS t FROM events) WHERE t BETWEEN 100 AND 130 AND user_id % 3 = 0""")
def series_window(spark, sf):
    p = P.points(spark, sf)
    return R.series_window(p, 100.0, 130.0, F.col("track_id") % 3 == 0).select("event_id", F.col("track_id").alias("user_id"), F.round("t", 6).alias("t"))


@query("""SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag) * 2 + GROUPING(l_linestatus) AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def extra_cube_rollup(spark, sf):
    c = P.read(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return c.select("l_returnflag", "l_linestatus", "level", "n", "quantity")


@query("""WITH f AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events))
  SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS last_event, count(*) AS n FROM f GROUP BY user_id, s""")
def extra_session_windows(spark, sf):
    e = P.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return s.select("user_id", F.unix_micros("a").alias("started"), F.unix_micros("b").alias("last_event"), "n")


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01')) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def extra_tumbling_windows(spark, sf):
    e = P.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.unix_micros("w.start").alias("started"), "event_type", "n", "total")


@query()
def best_candidate_paths(spark, sf):
    from ..operators import solve as V

    p = P.points(spark, sf)
    frames = p.select(F.col("track_id"), F.floor(F.col("t") / 8).cast("long").alias("frame"), F.col("event_id").alias("id"), "x", "z", "conf").withColumn("t", F.col("frame") * 8.0)
    return V.solve_paths(frames, "track_id")


@query()
def second_order_paths(spark, sf):
    from ..operators import paths as M

    p = P.points(spark, sf)
    frames = p.select(
        "track_id", F.floor(F.col("t") / 8).cast("long").alias("frame"), F.when(F.col("kind") != "error", F.col("event_id")).alias("id"), (F.col("x") * 20).alias("x"), (F.col("z") * 10).alias("y"), "conf",
        F.when(F.col("event_id") % 5 > 0, F.col("x") * 20 + 3).alias("sx"), (F.col("z") * 10 - 3).alias("sy"), F.when(F.col("event_id") % 3 > 0, F.col("x")).alias("px"), F.when(F.col("event_id") % 7 > 0, F.col("z")).alias("pz"),
    ).withColumn("t", F.col("frame") * 0.2)
    return M.solve_motion(frames, "track_id")


@query()
def warped_alignment(spark, sf):
    from ..operators import solve as V

    series = V.resampled(P.points(spark, sf), "track_id", "conf", 24)
    pairs = series.alias("a").join(series.alias("b"), F.col("b.track_id") == F.col("a.track_id") + 1)
    return pairs.select(F.col("a.track_id").alias("a_id"), F.col("b.track_id").alias("b_id"), F.round(V.warp_cost(F.col("a.v"), F.col("b.v")), 6).alias("cost"))
