"""Queries of the corrections: an order is an edit of its customer's scene."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import corrections as C
from ..operators import lineage as L
from ..sources import proxies as P
from .registry import query

#: The k-th order of a customer is a split of what the (k / 2)-th made; every fifth of the scene itself.
_SPLITS = """(SELECT o_custkey AS scene, o_orderkey AS id, CASE WHEN k > 1 AND k % 5 <> 0 THEN first_value(o_orderkey) OVER w END AS parent, (o_orderkey * 7) % 37 AS start, (o_orderkey * 11) % 41 AS stop FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY k RANGE BETWEEN k - k // 2 PRECEDING AND k - k // 2 PRECEDING))"""


def splits(spark, sf):
    o = P.read(spark, sf, "orders").select(F.col("o_custkey").alias("scene"), F.col("o_orderkey").alias("id"))
    o = o.withColumn("k", F.row_number().over(Window.partitionBy("scene").orderBy("id")))
    above = o.select("scene", F.col("k").alias("half"), F.col("id").alias("parent"))
    o = o.withColumn("half", F.when((F.col("k") > 1) & (F.col("k") % 5 != 0), F.floor(F.col("k") / 2).cast("int"))).join(above, ["scene", "half"], "left")
    return o.select("scene", "id", F.concat(F.lit("made"), "parent").alias("source"), F.concat(F.lit("made"), "id").alias("produced"), (F.col("id") * 7 % 37).alias("start"), (F.col("id") * 11 % 41).alias("stop"))


@query(f"""WITH RECURSIVE s AS (SELECT scene, id, parent, start * 100000000000 + stop * 1000000000 + id AS key FROM {_SPLITS}),
  p AS (SELECT scene, id, [key] AS path FROM s WHERE parent IS NULL UNION ALL SELECT s.scene, s.id, list_append(p.path, s.key) FROM s JOIN p ON s.scene = p.scene AND s.parent = p.id)
  SELECT scene, id, row_number() OVER (PARTITION BY scene ORDER BY list_filter(path, lambda k, i: k = list_max(path[i:]))) AS position FROM p""")
def split_order(spark, sf):
    return C.ordered_splits(splits(spark, sf))


#: Edits of a part: its lines, by order and number. What a writer saw is sometimes a revision too early or late.
_LOG = """(SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_quantity % 5 = 0 THEN 'undo' WHEN l_quantity % 7 = 0 THEN 'delete' ELSE 'set' END AS op,
  greatest(0, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) - 1 - l_suppkey % 2 * (l_linenumber % 2))::BIGINT AS expected, l_suppkey AS value FROM lineitem)"""


def edits(spark, sf):
    """Lines with one order and number are numbered as the log takes them, by op and value; the SQL leaves their order open."""
    op = F.when(F.col("l_quantity") % 5 == 0, "undo").when(F.col("l_quantity") % 7 == 0, "delete").otherwise("set")
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", op, "l_suppkey")
    seen = F.greatest(F.lit(0), F.row_number().over(w) - 1 - F.col("l_suppkey") % 2 * (F.col("l_linenumber") % 2)).cast("bigint")
    return P.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), op.alias("op"), seen.alias("expected"), F.col("l_suppkey").alias("value"))


_FOLDED = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, op, expected, value) AS k FROM {_LOG}),
  f AS (SELECT DISTINCT id, 0::BIGINT AS k, 0::BIGINT AS seq, 0::BIGINT AS revision, []::BIGINT[] AS stack, ''::VARCHAR AS verdict FROM e UNION ALL
    SELECT e.id, e.k, e.seq, CASE WHEN expected = revision AND NOT (op = 'undo' AND len(stack) = 0) THEN revision + 1 ELSE revision END,
      CASE WHEN expected <> revision THEN stack WHEN op = 'undo' THEN stack[:len(stack) - 1] ELSE list_append(stack, CASE WHEN op = 'set' THEN value END) END,
      CASE WHEN expected <> revision THEN 'conflict' WHEN op = 'undo' AND len(stack) = 0 THEN 'nothing-to-undo' ELSE 'accepted' END FROM f JOIN e ON e.id = f.id AND e.k = f.k + 1)"""


@query(f"{_FOLDED} SELECT id, seq, verdict, revision, stack[len(stack)] AS value FROM f WHERE k > 0")
def correction_log(spark, sf):
    return C.log_verdicts(edits(spark, sf), ["id"])


@query(f"{_FOLDED} SELECT id, revision, stack[len(stack)] AS value FROM f WHERE (id, k) IN (SELECT id, max(k) FROM f GROUP BY id) AND stack[len(stack)] IS NOT NULL")
def correction_state(spark, sf):
    return C.log_state(C.log_verdicts(edits(spark, sf), ["id"]), ["id"])


@query()
def roster_decisions(spark, sf):
    log = P.read(spark, sf, "lineitem").selectExpr("l_suppkey AS scene", "l_orderkey * 10 + l_linenumber AS seq", "string(l_partkey % 7) AS person", "CASE int(l_quantity) % 6 WHEN 0 THEN 'unbind' WHEN 1 THEN 'undo' WHEN 2 THEN 'clear' ELSE 'bind' END AS op", "string(l_partkey % 5) AS player")
    return C.roster_log(log)


@query("""SELECT scene, person, player, min(said) AS said FROM (SELECT l_orderkey AS scene, l_suppkey AS person, l_partkey % 5 AS player, l_linenumber AS said FROM lineitem) d
  WHERE (scene, person, player) IN (SELECT l_orderkey, l_suppkey, l_partkey % 5 FROM lineitem WHERE l_quantity > 10) AND (scene, person, player) NOT IN (SELECT l_orderkey, l_suppkey, l_partkey % 5 FROM lineitem WHERE l_quantity > 45) GROUP BY ALL""")
def standing_rejections(spark, sf):
    said = P.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scene"), F.col("l_suppkey").alias("person"), (F.col("l_partkey") % 5).alias("player"), F.col("l_linenumber").alias("said"), "l_quantity")
    return C.rejections(said.drop("l_quantity"), said.where("l_quantity > 10"), said.where("l_quantity > 45"))


_SPLIT = "(SELECT o_custkey AS track_id, min(o_orderkey % 600)::DOUBLE AS start, min(o_orderkey % 600)::DOUBLE + 100 AS stop, -o_custkey AS new_id FROM orders GROUP BY 1)"


@query(f"""WITH r AS (SELECT p.*, coalesce(new_id, p.track_id) AS new_track FROM {P.POINTS} p LEFT JOIN {_SPLIT} s ON p.track_id = s.track_id AND s.start <= t AND t < s.stop)
  SELECT new_track, count(*) AS n, sum(observed::INT)::BIGINT AS observed, min(t) AS first, max(t) AS last, round(avg(conf), 9) AS conf, max(conf) AS best_conf, arg_min(event_id, (-conf, t, event_id)) AS best_id,
    (SELECT kind FROM r q WHERE q.new_track = r.new_track GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1) AS kind FROM r GROUP BY new_track""")
def split_partitions(spark, sf):
    s = P.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("track_id")).agg(F.min(F.col("o_orderkey") % 600).cast("double").alias("start"))
    moved = L.split_tracks(P.points(spark, sf), s.select("track_id", "start", (F.col("start") + 100).alias("stop"), (-F.col("track_id")).alias("new_id")))
    return C.partition_state(moved, "new_track").withColumn("conf", F.round("conf", 9))
