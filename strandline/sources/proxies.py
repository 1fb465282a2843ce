"""Views of the given tables as observation data, for the queries of ``plans``.

Each proxy exists twice, as a DataFrame and as a SQL subquery with the same columns, so that a query
and its SQL counterpart start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01T00:00:00Z in microseconds.
EPOCH = 1_704_067_200_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, track_id, t (hours), x, z, conf, observed, kind."""
    k = F.get_json_object("props", "$.k").cast("double")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("track_id"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH)) / F.lit(3.6e9)).alias("t"),
        F.col("value").alias("x"),
        k.alias("z"),
        (k / 100).alias("conf"),
        (F.col("event_type") != "error").alias("observed"),
        F.col("event_type").alias("kind"),
    )


POINTS = f"""(SELECT event_id, user_id AS track_id, (epoch_us(ts) - {EPOCH})::DOUBLE / 3.6e9::DOUBLE AS t, value AS x,
  (props->>'$.k')::DOUBLE AS z, (props->>'$.k')::DOUBLE / 100 AS conf, event_type <> 'error' AS observed, event_type AS kind FROM events)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner, id, s, e: half-open intervals in days."""
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), day.cast("double").alias("s"), (day + 1 + F.col("o_orderkey") % 30).cast("double").alias("e"))


INTERVALS = """(SELECT o_custkey AS owner, o_orderkey AS id, (o_orderdate::DATE - DATE '1970-01-01')::DOUBLE AS s,
  ((o_orderdate::DATE - DATE '1970-01-01') + 1 + o_orderkey % 30)::DOUBLE AS e FROM orders)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, id, x, y, w, h, score, side ('gt' or 'pred')."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"),
        F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("id"),
        F.col("l_quantity").alias("x"),
        (F.col("l_discount") * 100).alias("y"),
        F.lit(20.0).alias("w"),
        F.lit(40.0).alias("h"),
        (F.col("l_extendedprice") / F.lit(1e6)).alias("score"),
        F.when(F.col("l_linenumber") % 2 == 1, "gt").otherwise("pred").alias("side"),
    )


BOXES = """(SELECT l_orderkey AS frame, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS id, l_quantity AS x, l_discount * 100 AS y,
  20.0::DOUBLE AS w, 40.0::DOUBLE AS h, l_extendedprice / 1e6::DOUBLE AS score, CASE WHEN l_linenumber % 2 = 1 THEN 'gt' ELSE 'pred' END AS side FROM lineitem)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, person, v: unit vectors of doubles."""
    from ..functions.vector import normalize

    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("person"), normalize(F.col("embedding").cast("array<double>")).alias("v"))


VECTORS = """(SELECT id, person, list_transform(d, lambda c: c / n) AS v FROM (SELECT vec_id AS id, label AS person, embedding::DOUBLE[] AS d,
  sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda c: c * c))) AS n FROM embeddings))"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tracklet, t (days), number, conf."""
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("id"),
        F.col("l_suppkey").alias("tracklet"),
        F.unix_date(F.col("l_shipdate").cast("date")).cast("double").alias("t"),
        F.col("l_linenumber").alias("number"),
        (1 - F.col("l_discount")).alias("conf"),
    )


READINGS = """(SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_suppkey AS tracklet,
  (l_shipdate::DATE - DATE '1970-01-01')::DOUBLE AS t, l_linenumber AS number, 1 - l_discount AS conf FROM lineitem)"""


def assign_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, seq, t, gt, pred (null: nothing predicted)."""
    return points(spark, sf_dir).select("event_id", F.col("track_id").alias("seq"), "t", F.col("track_id").alias("gt"), F.when(F.col("kind") != "error", F.col("kind")).alias("pred"))


ASSIGN_ROWS = f"(SELECT event_id, track_id AS seq, t, track_id AS gt, CASE WHEN kind <> 'error' THEN kind END AS pred FROM {POINTS})"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, truth (0/1), score."""
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("truth"), F.col("n_chars").cast("double").alias("score"))


LABELLED = "(SELECT doc_id AS id, quality AS truth, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, hash, quality: documents by the digest of their text."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.col("n_chars").alias("quality"))


CONTENT = "(SELECT doc_id AS id, sha256(text) AS hash, n_chars AS quality FROM documents)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, status, available (epoch days), requested."""
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("double")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), day.alias("available"), (day - F.col("o_orderkey") % 7).alias("requested"))


JOBS = "(SELECT o_orderkey AS id, o_orderstatus AS status, (o_orderdate::DATE - DATE '1970-01-01')::DOUBLE AS available, ((o_orderdate::DATE - DATE '1970-01-01') - o_orderkey % 7)::DOUBLE AS requested FROM orders)"


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, expires: the last ship date of an order's lines."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.max(F.unix_date(F.col("l_shipdate").cast("date"))).cast("double").alias("expires"))


LEASES = "(SELECT l_orderkey AS job_id, max(l_shipdate::DATE - DATE '1970-01-01')::DOUBLE AS expires FROM lineitem GROUP BY 1)"
