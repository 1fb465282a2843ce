"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of language-model scoring and of the n-gram join: runs without ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share, from ``spark.checkpoint.dir``.

    Only in one process (tests), where the session names none, a new local one is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's settings while a table is written: a query's shuffle files go when it has ended; texts may be
#: long, so few of them are sent to Python at once.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation of what stands before; so the
    shuffle files of the write are not needed again and go at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.mode("error").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keyed_text(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Two columns for an Arrow function: ``key``, a struct of the kept columns, and ``text``.

    A text that is kept is not sent twice: ``text`` is null then, see ``texts_of``.
    """
    text = F.lit(None).cast("string") if "text" in keep else F.col("text")
    return docs.select(F.struct(*keep).alias("key"), text.alias("text"))


def unless_named(keep: list[str], results: list[str]) -> list[str]:
    """The kept columns, without those that have the name of a result (names without regard to case)."""
    taken = {r.lower() for r in results}
    return [c for c in keep if c.lower() not in taken]


def texts_of(batch):
    """The texts of a batch of ``keyed_text``, as an Arrow array."""
    key = batch.column(0)
    return key.field("text") if key.type.get_field_index("text") >= 0 else batch.column(1)
