"""Content-addressed records, journals, manifests and versioned caches, as Spark tables.

A record's address is the sha256 of its canonical JSON (sorted keys, nulls written). Tables are
partitioned by the first digits of the address, so a lookup reads one folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_json

RECORD = "kind string, digest string, body string, prefix string"


def addressed(rows: DataFrame, kind: str) -> DataFrame:
    """Each row as a record: kind, digest, body (canonical JSON), prefix. Equal rows are one record."""
    body = canonical_json(**{c: F.col(c) for c in rows.columns})
    out = rows.select(F.lit(kind).alias("kind"), body.alias("body")).distinct()
    return out.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256)).withColumn("prefix", F.substring("digest", 1, 2)).select("kind", "digest", "body", "prefix")


def put(rows: DataFrame, kind: str, path: str) -> DataFrame:
    """Append the records that the store does not have; gives all records of ``rows``."""
    spark = rows.sparkSession
    made = addressed(rows, kind)
    new, stored = made, stored_records(spark, path)
    if stored is not None:
        new = made.join(stored.select("digest"), "digest", "left_anti").select("kind", "digest", "body", "prefix")
    new.write.mode("append").partitionBy("prefix").parquet(path)
    return made


def stored_records(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(RECORD).parquet(path)


def fetch(spark: SparkSession, path: str, digests: list[str]) -> DataFrame:
    """Records by address; one that is absent, or whose body does not have its address, makes the job fail."""
    asked = spark.createDataFrame([(d,) for d in sorted(set(digests))], "digest string")
    found = spark.read.schema(RECORD).parquet(path).where(F.col("prefix").isin(sorted({d[:2] for d in digests})) & F.col("digest").isin(digests))
    good = F.sha2(F.col("body").cast("binary"), 256) == F.col("digest")
    fail = F.raise_error(F.concat(F.when(F.col("body").isNull(), "absent").otherwise("corrupt"), F.lit(" record "), F.col("digest"))).cast("string")
    return found.join(asked, "digest", "right").select("kind", "digest", F.when(good, F.col("body")).otherwise(fail).alias("body"))


def append_journal(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def newest(rows: DataFrame, key: str, time: str) -> DataFrame:
    """The newest row of each key; the larger row on a tie."""
    w = Window.partitionBy(key).orderBy(F.desc(time), *[F.desc(c) for c in rows.columns if c not in (key, time)])
    return rows.withColumn("k_", F.row_number().over(w)).where("k_ = 1").drop("k_")


def contract_key(**contract: Column) -> Column:
    """Cache key of everything that a cached result depends on."""
    return F.sha2(canonical_json(**contract).cast("binary"), 256)


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON manifest of one document per file; a malformed one fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def sampled_frames(frames: DataFrame, by: str, rate: float) -> DataFrame:
    """The frame nearest to each tick of a target rate, once: tick floor(t * rate + 0.5), ties to the earlier."""
    tick = F.floor(F.col("t") * rate + 0.5).cast("long")
    near = frames.withColumn("tick", tick).withColumn("d", F.abs(F.col("t") - F.col("tick") / rate))
    best = near.groupBy(by, "tick").agg(F.min(F.struct("d", "t", "frame")).alias("b"))
    return best.select(by, "tick", F.col("b.frame").alias("frame"), F.col("b.t").alias("t"))
