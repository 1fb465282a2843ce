"""Query of terminal publications: the lines of an order are tries to publish its document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import proxies as P
from ..streaming import publish
from .registry import query

_JOBS = "(SELECT o_orderkey::VARCHAR AS scene, (o_custkey % 50)::VARCHAR AS run, o_orderpriority AS fingerprint, CASE WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'done' END AS status FROM orders)"


@query(f"""WITH j AS {_JOBS}, l AS (SELECT o_orderkey::VARCHAR AS scene, 'w' || o_orderkey % 3 AS owner, (o_orderkey % 40)::DOUBLE AS expires FROM orders WHERE o_orderkey % 10 > 0),
  c AS (SELECT o_orderkey::VARCHAR AS scene, 1::BIGINT AS revision, CASE WHEN o_orderkey % 8 = 0 THEN (o_custkey % 50)::VARCHAR ELSE 'before' END AS run FROM orders WHERE o_orderkey % 4 = 0),
  p AS (SELECT l_orderkey::VARCHAR AS scene, (o_custkey % 50 + l_linenumber % 6 // 5)::VARCHAR AS run, CASE WHEN l_tax > 0.07 THEN 'other' ELSE o_orderpriority END AS fingerprint, CASE WHEN l_discount > 0.08 THEN 'w9' ELSE 'w' || l_orderkey % 3 END AS owner,
    l_quantity AS moment, l_linenumber::BIGINT AS seq, CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE l_linenumber // 7 END::BIGINT AS expected, CASE WHEN l_returnflag = 'R' THEN 'running' ELSE 'succeeded' END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  w AS (SELECT p.*, c.revision AS stands, CASE WHEN p.status = 'running' THEN 'not-terminal' WHEN c.run = p.run THEN 'published-already' WHEN j.run IS DISTINCT FROM p.run THEN 'other-run' WHEN j.fingerprint <> p.fingerprint THEN 'other-input' WHEN j.status <> 'processing' THEN 'not-processing'
      WHEN l.owner IS DISTINCT FROM p.owner OR l.expires <= p.moment THEN 'lease-lost' WHEN p.expected <> coalesce(c.revision, 0) THEN 'stale-revision' END AS wrong
    FROM p LEFT JOIN j ON j.scene = p.scene LEFT JOIN l ON l.scene = p.scene LEFT JOIN c ON c.scene = p.scene),
  v AS (SELECT *, coalesce(wrong, CASE WHEN row_number() OVER (PARTITION BY scene, wrong IS NULL ORDER BY moment, seq) = 1 THEN 'accepted' ELSE 'late' END) AS verdict FROM w)
  SELECT scene, seq, verdict, CASE WHEN verdict = 'accepted' THEN coalesce(stands, 0) + 1 ELSE 0 END AS revision FROM v""")
def publication_verdicts(spark, sf):
    o = P.read(spark, sf, "orders")
    jobs = o.selectExpr("string(o_orderkey) AS scene", "string(o_custkey % 50) AS run", "o_orderpriority AS fingerprint", "if(o_orderstatus = 'O', 'processing', 'done') AS status")
    leases = o.where("o_orderkey % 10 > 0").selectExpr("string(o_orderkey) AS scene", "concat('w', o_orderkey % 3) AS owner", "double(o_orderkey % 40) AS expires")
    current = o.where("o_orderkey % 4 = 0").selectExpr("string(o_orderkey) AS scene", "1L AS revision", "if(o_orderkey % 8 = 0, string(o_custkey % 50), 'before') AS run")
    said = P.read(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "string(l_orderkey) AS scene", "string(o_custkey % 50 + l_linenumber % 6 div 5) AS run", "if(l_tax > 0.07, 'other', o_orderpriority) AS fingerprint", "if(l_discount > 0.08, 'w9', concat('w', l_orderkey % 3)) AS owner",
        "l_quantity AS at", "bigint(l_linenumber) AS seq", "bigint(if(l_orderkey % 4 = 0, 1, l_linenumber div 7)) AS expected", "if(l_returnflag = 'R', 'running', 'succeeded') AS status",
    )
    told = publish.verdicts(said, jobs, leases, current)
    return told.select("scene", "seq", "verdict", F.coalesce("revision", F.lit(0)).cast("long").alias("revision"))
