"""Queries of the review operators, and the plain scans of the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import review as R
from ..sources import proxies as P
from .registry import query

D = "::DOUBLE"


@query(f"""SELECT owner, id, score, duration, duration >= 4 AND row_number() OVER (PARTITION BY owner, duration >= 4 ORDER BY score DESC, duration DESC, id) <= 5 AS recommended FROM (SELECT owner, id, id % 10 AS score, e - s AS duration FROM {P.INTERVALS})""")
def recommended_shots(spark, sf):
    return R.recommended_shots(P.intervals(spark, sf).select("owner", "id", (F.col("id") % 10).alias("score"), (F.col("e") - F.col("s")).alias("duration")))


@query(f"""SELECT id, status, row_number() OVER (ORDER BY CASE WHEN status = 'P' THEN 0 ELSE 1 END, available DESC, id) AS place FROM {P.JOBS}""")
def ordered_jobs(spark, sf):
    return R.ordered_jobs(P.jobs(spark, sf), ["P"])


@query(f"""SELECT frame, id, row_number() OVER (PARTITION BY frame ORDER BY CASE WHEN dx <= w / 2 AND dy <= h / 2 THEN 0 ELSE 1 END, w * h, dx * dx + dy * dy, score DESC, id) AS rank
  FROM (SELECT *, abs(30.0{D} - x - w / 2) AS dx, abs(20.0{D} - y - h / 2) AS dy FROM (SELECT frame, id, x, y, x / 2 + 1 AS w, y + 10 AS h, score FROM {P.BOXES})) WHERE dx <= greatest(w, 12.0{D}) / 2 AND dy <= greatest(h, 12.0{D}) / 2""")
def hits_under_point(spark, sf):
    return R.hits_under_point(P.boxes(spark, sf).withColumns({"w": F.col("x") / 2 + 1, "h": F.col("y") + 10}), 30.0, 20.0, 12.0)


@query("""SELECT track, count(*) AS frames, count(*) FILTER (step > 1) AS gaps FROM (SELECT track, frame - lag(frame) OVER (PARTITION BY track ORDER BY frame) AS step FROM (SELECT DISTINCT l_suppkey AS track, l_orderkey AS frame FROM lineitem)) GROUP BY 1""")
def interior_gaps(spark, sf):
    return R.interior_gaps(P.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("track"), F.col("l_orderkey").alias("frame")))


@query(f"""WITH q AS (SELECT i * 90.0{D} AS q FROM range(8) r(i)), p AS (SELECT track_id, t, observed, event_id, row_number() OVER (PARTITION BY track_id ORDER BY t, event_id) AS k FROM {P.POINTS}),
  g AS (SELECT track_id, q, max(k) FILTER (t < q) AS a, min(k) FILTER (t >= q) AS b, max(k) AS n, min(t) AS t0, max(t) AS t1, min(t) FILTER (observed) AS f, max(t) FILTER (observed) AS l, bool_or(observed AND abs(t - q) <= 0.001) AS near FROM p, q GROUP BY ALL)
  SELECT g.track_id, g.q, CASE WHEN near THEN 'observed' WHEN g.q < f OR g.q > l THEN 'outside-observed-window' ELSE 'inferred-gap' END AS state,
    CASE WHEN g.q <= t0 THEN NOT x.observed WHEN g.q >= t1 THEN NOT z.observed ELSE NOT pa.observed OR NOT pb.observed END AS inferred
  FROM g LEFT JOIN p pa ON pa.track_id = g.track_id AND pa.k = a LEFT JOIN p pb ON pb.track_id = g.track_id AND pb.k = b JOIN p x ON x.track_id = g.track_id AND x.k = 1 JOIN p z ON z.track_id = g.track_id AND z.k = n""")
def presence_at(spark, sf):
    return R.presence_at(P.points(spark, sf), spark.range(8).select((F.col("id") * 90.0).alias("q")))


@query(f"""SELECT frame, id, CASE WHEN h < 14 OR w < 5 OR h < w * 1.05{D} THEN 'rejected-box-shape' WHEN y + h < 18 THEN 'rejected-foot-above-horizon' WHEN g < 0.38{D} AND NOT (c >= 0.55{D} AND y + h >= 24 AND g >= 0.15{D}) THEN 'rejected-off-grass'
  WHEN y + h < 34 THEN CASE WHEN c >= 0.12{D} AND (g >= 0.52{D} OR c >= 0.55{D}) THEN 'accepted-shallow' ELSE 'rejected-shallow-low-confidence' END ELSE 'accepted' END AS verdict
  FROM (SELECT frame, id, y, x / 3 + 3 AS w, x AS h, score * 8 AS c, y / 10 AS g FROM {P.BOXES})""")
def person_gate(spark, sf):
    x, y = F.col("x"), F.col("y")
    return P.boxes(spark, sf).select("frame", "id", R.person_gate(x, y, x / 3 + 3, x, F.lit(100.0), F.col("score") * 8, y / 10).alias("verdict"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN CASE o_orderkey % 5 WHEN 0 THEN 'person' WHEN 1 THEN 'ball' WHEN 2 THEN 'person' ELSE 'other' END ELSE CASE o_orderkey % 40 WHEN 0 THEN 'person' WHEN 32 THEN 'ball' ELSE 'other' END END AS kind FROM orders""")
def detection_kinds(spark, sf):
    names = F.array(*map(F.lit, (" Player", "Sports Ball", "REFEREE ", "bird", "person2")))
    name = F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int"))
    return P.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), R.detection_kind(F.col("o_orderkey") % 40, name, F.col("o_custkey") % 2 == 0).alias("kind"))


@query(f"""SELECT track_id AS scene, CASE WHEN kind = 'error' THEN 'ball' ELSE 'person' END AS kind, CASE WHEN kind = 'error' THEN 'ball' ELSE kind END AS track, t, x FROM {P.POINTS}""")
def exploded_keyframes(spark, sf):
    p, frame = P.points(spark, sf), F.collect_list(F.struct("t", "x"))
    tracks = p.where("kind <> 'error'").groupBy("track_id", "kind").agg(frame.alias("k")).groupBy("track_id").agg(F.collect_list(F.struct(F.col("kind").alias("id"), F.col("k").alias("keyframes"))).alias("tracks"))
    ball = p.where("kind = 'error'").groupBy("track_id").agg(frame.alias("ball"))
    return R.keyframes(tracks.join(ball, "track_id", "full_outer").withColumnRenamed("track_id", "scene"))


@query(f"""SELECT frame, count(*) AS n FROM {P.BOXES} WHERE frame NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def kept_frames(spark, sf):
    excluded = P.read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("frame"))
    return R.without_frames(P.boxes(spark, sf), excluded, ["frame"]).groupBy("frame").agg(F.count("*").alias("n"))


NOTES = """(SELECT o_orderkey AS id, o_custkey AS track, d AS s, d + 200 AS e, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 END AS observation, CASE WHEN o_orderkey % 7 <> 0 THEN d + o_orderkey % 400 - 100 END AS time,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS annotation, o_orderkey % 5 AS seen FROM (SELECT *, (o_orderdate::DATE - DATE '1970-01-01')::DOUBLE AS d FROM orders))"""


@query(f"""SELECT id, CASE WHEN pi AND po THEN 'ambiguous' WHEN pi THEN 'range' WHEN po THEN 'remaining' WHEN si AND so THEN 'ambiguous' WHEN si THEN 'range' WHEN so THEN 'remaining' WHEN time IS NULL THEN 'unknown' WHEN time >= s AND time < e THEN 'range' ELSE 'remaining' END AS side FROM (
  SELECT a.id, a.s, a.e, a.time, bool_or(coalesce(p.annotation = a.id, false) AND p.s >= a.s AND p.s < a.e) AS pi, bool_or(coalesce(p.annotation = a.id, false) AND NOT (p.s >= a.s AND p.s < a.e)) AS po,
    bool_or(coalesce(p.seen = a.observation, false) AND p.s >= a.s AND p.s < a.e) AS si, bool_or(coalesce(p.seen = a.observation, false) AND NOT (p.s >= a.s AND p.s < a.e)) AS so
  FROM {NOTES} a LEFT JOIN {NOTES} p USING (track) GROUP BY ALL)""")
def annotation_sides(spark, sf):
    d = F.unix_date(F.col("o_orderdate").cast("date")).cast("double")
    o = P.read(spark, sf, "orders").withColumn("d", d)
    notes = o.selectExpr("o_orderkey AS id", "o_custkey AS track", "d AS s", "d + 200 AS e", "if(o_orderkey % 3 = 0, o_orderkey % 5, null) AS observation", "if(o_orderkey % 7 <> 0, d + o_orderkey % 400 - 100, null) AS time")
    return R.annotation_sides(notes, o.selectExpr("o_custkey AS track", "d AS t", "if(o_orderkey % 4 = 0, o_orderkey, null) AS annotation", "o_orderkey % 5 AS observation"))


@query(f"""SELECT id, CASE WHEN status = 'scored' THEN round(least(a, b) + (greatest(a, b) - least(a, b)) * 0.5{D}, 3) END AS p50, CASE WHEN status = 'scored' THEN round(least(a, b) + (greatest(a, b) - least(a, b)) * 0.95{D}, 3) END AS p95, status FROM (
  SELECT frame || '/' || id AS id, abs(dx * (y - 3.5{D}) - dy * (x - 2.5{D})) / n AS a, abs(dx * (y + 40 - 3.5{D}) - dy * (x + 20 - 2.5{D})) / n AS b, CASE WHEN frame % 5 = 0 THEN 'not-scored-3d' WHEN n >= 1e-7 AND frame % 7 <> 0 THEN 'scored' ELSE 'not-scored' END AS status
  FROM (SELECT *, sqrt(dx * dx + dy * dy) AS n FROM (SELECT *, y - 2.5{D} AS dx, x - 3.5{D} AS dy FROM {P.BOXES})))""")
def line_residuals(spark, sf):
    b = P.boxes(spark, sf)
    lines = b.select(F.concat_ws("/", F.col("frame").cast("string"), "id").alias("id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 20).alias("x2"), (F.col("y") + 40).alias("y2"), F.lit(2.5).alias("mx1"), F.lit(3.5).alias("my1"), F.col("y").alias("mx2"), F.when(F.col("frame") % 7 != 0, F.col("x")).alias("my2"), (F.col("frame") % 5 != 0).alias("ground"))
    return R.line_residuals(lines)


@query(f"""SELECT frame, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(1e-9{D}, p + r), 6) AS f1, round(p50, 6) AS p50, round(p95, 6) AS p95 FROM (
  SELECT frame, avg(CASE WHEN v <= 3 THEN 1.0{D} ELSE 0 END) FILTER (side = 'gt') AS p, avg(CASE WHEN v <= 3 THEN 1.0{D} ELSE 0 END) FILTER (side = 'pred') AS r, quantile_cont(v, 0.5) FILTER (side = 'gt') AS p50, quantile_cont(v, 0.95) FILTER (side = 'gt') AS p95
  FROM (SELECT *, x / 5 * 0.5{D} AS v FROM {P.BOXES}) GROUP BY 1) WHERE p IS NOT NULL AND r IS NOT NULL""")
def line_alignment(spark, sf):
    rows = P.boxes(spark, sf).select("frame", F.when(F.col("side") == "gt", "model").otherwise("observed").alias("side"), (F.col("x") / 5).alias("distance"), R.pixel_scale(F.lit(1920.0), F.lit(1080.0)).alias("scale"))
    return R.alignment(rows).select("frame", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "p50", "p95")))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS frame, l_suppkey % 3 AS item FROM lineitem WHERE l_linenumber % 2 = 1), b AS (SELECT DISTINCT l_orderkey AS frame, l_suppkey % 3 AS item FROM lineitem WHERE l_linenumber % 2 = 0)
  SELECT frame, n = na AS subset, n = 0 AS disjoint, n = na AND n = nb AS same FROM (SELECT coalesce(a.frame, b.frame) AS frame, count(a.item) AS na, count(b.item) AS nb, count(*) FILTER (a.item = b.item) AS n FROM a FULL JOIN b ON a.frame = b.frame AND a.item = b.item GROUP BY 1)""")
def set_relations(spark, sf):
    rows = P.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame"), (F.col("l_suppkey") % 3).alias("item"), (F.col("l_linenumber") % 2).alias("odd"))
    return R.set_relations(rows.where("odd = 1"), rows.where("odd = 0"), "frame", "item")


@query("SELECT o_orderkey AS id, o_custkey AS owner, o_orderstatus AS status FROM orders WHERE o_orderkey = 7")
def scan_by_key(spark, sf):
    return P.read(spark, sf, "orders").where("o_orderkey = 7").selectExpr("o_orderkey AS id", "o_custkey AS owner", "o_orderstatus AS status")


@query("SELECT doc_id AS id, lang, source, n_chars FROM documents")
def scan_without_text(spark, sf):
    return P.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars").orderBy(F.desc("n_chars"), "id")


@query("SELECT l_orderkey AS id, l_linenumber AS line, l_quantity AS q FROM lineitem WHERE l_suppkey = 3 AND l_returnflag = 'R' AND l_linestatus = 'F'")
def scan_by_three_columns(spark, sf):
    return P.read(spark, sf, "lineitem").where("l_suppkey = 3 AND l_returnflag = 'R' AND l_linestatus = 'F'").selectExpr("l_orderkey AS id", "l_linenumber AS line", "l_quantity AS q")


@query("SELECT owner, id, k FROM (SELECT o_custkey AS owner, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= greatest(1, owner % 4)")
def latest_of_owner(spark, sf):
    """The owner's latest rows, at least one whatever number was asked for."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("long")
    rows = P.read(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), k.alias("k"))
    return rows.where(F.col("k") <= F.greatest(F.lit(1), F.col("owner") % 4))


@query("""SELECT frame, string_agg(item::VARCHAR, ',' ORDER BY first) AS items FROM (SELECT l_orderkey AS frame, l_suppkey % 4 AS item, min(l_linenumber * 1000000 + l_suppkey) AS first FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def first_occurrences(spark, sf):
    """Order-preserving unique values of each frame."""
    line = F.struct((F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("at"), (F.col("l_suppkey") % 4).alias("item"))
    rows = P.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(F.sort_array(F.collect_list(line)).alias("r"))
    return rows.select("frame", F.concat_ws(",", F.transform(F.array_distinct("r.item"), lambda x: x.cast("string"))).alias("items"))


@query("""SELECT c_custkey AS id, count(o_orderkey) AS children, count(*) FILTER (o_orderstatus = 'F') AS done, arg_max(o_orderstatus, o_orderkey) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def listing_with_children(spark, sf):
    """Every parent with the state of its children; children are summed up before the join."""
    children = P.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("children"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.max_by("o_orderstatus", "o_orderkey").alias("latest"))
    return P.read(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(children, "id", "left").select("id", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("done", F.lit(0)).alias("done"), "latest")


@query("""SELECT c_custkey AS person, coalesce(string_agg(m, ',' ORDER BY m), '') AS memberships FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, o_orderpriority AS m FROM orders) ON o_custkey = c_custkey GROUP BY 1""")
def people_with_memberships(spark, sf):
    lists = P.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("person")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("m"))
    return P.read(spark, sf, "customer").select(F.col("c_custkey").alias("person")).join(lists, "person", "left").select("person", F.coalesce("m", F.lit("")).alias("memberships"))


@query("""SELECT a.l_suppkey AS source, a.l_partkey AS event, count(*) AS n, min(abs(a.l_shipdate::DATE - b.l_shipdate::DATE)) AS nearest FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey
  WHERE a.l_linenumber % 2 = 1 AND b.l_linenumber % 2 = 0 AND abs(a.l_shipdate::DATE - b.l_shipdate::DATE) <= 400 GROUP BY 1, 2""")
def shared_events(spark, sf):
    """Events of both sides by source and event, near in time."""
    rows = P.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("event"), F.unix_date(F.col("l_shipdate").cast("date")).alias("d"), (F.col("l_linenumber") % 2).alias("odd"))
    a, b = rows.where("odd = 1").select("source", "event", F.col("d").alias("da")), rows.where("odd = 0").select("source", "event", F.col("d").alias("db"))
    apart = F.abs(F.col("da") - F.col("db"))
    return a.join(b, ["source", "event"]).where(apart <= 400).groupBy("source", "event").agg(F.count("*").alias("n"), F.min(apart).cast("long").alias("nearest"))
