"""Terminal publications as a stream writes them: fenced, once each, whatever is replayed.

A store is a folder of Parquet tables. A micro-batch writes its documents under its batch id, then its ledger;
the ledger is the commit. What is not in the ledger is not there, so a batch that failed half way is written
again over its own remains, and a batch that is in the ledger is left alone when it is replayed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEDGER = "scene string, run string, fingerprint string, owner string, at double, seq bigint, status string, verdict string, revision bigint"
DOCUMENTS = "scene string, run string, revision bigint, at double, body string"
TERMINAL = ("succeeded", "failed", "cancelled")


def verdicts(publications: DataFrame, jobs: DataFrame, leases: DataFrame, current: DataFrame) -> DataFrame:
    """``publications`` (scene, run, fingerprint, owner, at, seq, expected, status, ...) with verdict and revision.

    Accepted is a terminal status of a processing job (``jobs``: scene, run, fingerprint, status) by the owner of
    its lease (``leases``: scene, owner, expires; one that ends at that time is dead), whose writer saw the
    revision that stands (``current``: scene, revision, run; none: 0), where that run is not published already.
    Of a scene's good publications the first by time and seq is accepted and the others are late. The revision
    is the one after an accepted publication, null otherwise. A scene has one job and one lease at most.
    """
    p = publications.alias("p")
    j = jobs.select("scene", F.struct("run", "fingerprint", "status").alias("job"))
    held = leases.select("scene", F.struct("owner", "expires").alias("lease"))
    stands = current.select("scene", F.struct("revision", "run").alias("now"))
    rows = p.join(j, "scene", "left").join(held, "scene", "left").join(stands, "scene", "left")
    revision = F.coalesce("now.revision", F.lit(0))
    wrong = (
        F.when(~F.col("status").isin(*TERMINAL) | F.col("status").isNull(), "not-terminal")
        .when(F.col("now.run").eqNullSafe(F.col("run")) & F.col("run").isNotNull(), "published-already")
        .when(F.col("job").isNull() | ~F.col("job.run").eqNullSafe(F.col("run")), "other-run")
        .when(~F.col("job.fingerprint").eqNullSafe(F.col("fingerprint")), "other-input")
        .when(F.col("job.status") != "processing", "not-processing")
        .when(F.col("lease").isNull() | ~F.col("lease.owner").eqNullSafe(F.col("owner")) | (F.col("lease.expires") <= F.col("at")), "lease-lost")
        .when(~F.col("expected").eqNullSafe(revision), "stale-revision")
    )
    rows = rows.withColumn("wrong", wrong)
    place = F.row_number().over(Window.partitionBy("scene", F.col("wrong").isNull()).orderBy("at", "seq"))
    verdict = F.coalesce("wrong", F.when(place == 1, "accepted").otherwise("late"))
    out = rows.withColumn("verdict", verdict).withColumn("revision", F.when(F.col("verdict") == "accepted", revision + 1))
    return out.drop("job", "lease", "now", "wrong")


class Publications:
    """A store of published documents at ``path``, on a file system that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _is(self, table: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _read(self, table: str, schema: str) -> DataFrame:
        if not self._is(table):
            return self.spark.createDataFrame([], schema + ", batch bigint")
        return self.spark.read.schema(schema + ", batch bigint").option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}")

    def committed(self, batch_id: int) -> bool:
        return self._is(f"ledger/batch={batch_id}/_SUCCESS")

    def ledger(self, before: int | None = None) -> DataFrame:
        out = self._read("ledger", LEDGER)
        return out if before is None else out.where(F.col("batch") < before)

    def current(self, before: int | None = None) -> DataFrame:
        """scene, revision, run of what stands, after the committed batches (before one, if named)."""
        last = F.max_by(F.struct("revision", "run"), "revision")
        return self.ledger(before).where("verdict = 'accepted'").groupBy("scene").agg(last.alias("l")).select("scene", "l.*")

    def documents(self) -> DataFrame:
        """The document of each scene that stands: scene, run, revision, at, body."""
        return self._read("documents", DOCUMENTS).join(self.current(), ["scene", "revision", "run"], "left_semi").drop("batch")

    def commit(self, batch: DataFrame, batch_id: int, jobs: DataFrame, leases: DataFrame, written: Callable[[], None] = lambda: None) -> bool:
        """Write one micro-batch (as for ``verdicts``, with body); false if it is in the ledger already.

        The verdicts depend on the batch, the tables given and the ledger of earlier batches only, so a
        replay comes to the same. ``written`` is called between documents and ledger.
        """
        if self.committed(batch_id):
            return False
        told = verdicts(batch, jobs, leases, self.current(batch_id))
        good = told.where("verdict = 'accepted'")
        good.select("scene", "run", "revision", "at", "body").write.mode("overwrite").parquet(f"{self.path}/documents/batch={batch_id}")
        written()
        told.select(*(c.split()[0] for c in LEDGER.split(", "))).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch_id}")
        return True

    def sink(self, jobs: Callable[[], DataFrame], leases: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``; the tables of jobs and leases are read anew for each batch."""
        return lambda batch, batch_id: self.commit(batch, batch_id, jobs(), leases()) and None

    def missed_epilogues(self, recent: int = 20) -> DataFrame:
        """Of the ``recent`` last published runs that succeeded, those without a finished epilogue: scene, run, revision, at."""
        last = self.ledger().where("verdict = 'accepted' AND status = 'succeeded'").orderBy(F.desc("at"), "run").limit(recent)
        return last.select("scene", "run", "revision", "at").join(self._epilogues(), "run", "left_anti")

    def _epilogues(self) -> DataFrame:
        if not self._is("epilogues"):
            return self.spark.createDataFrame([], "scene string, run string")
        return self.spark.read.schema("scene string, run string").parquet(f"{self.path}/epilogues")

    def replay_epilogues(self, apply: Callable[[DataFrame], None], recent: int = 20) -> int:
        """Do what follows a publication for the runs that miss it, then note it; how many there were.

        ``apply`` gets the runs' documents and must come to the same if it is repeated: it is, for runs that
        were not noted because a failure came between.
        """
        missed = self.missed_epilogues(recent)
        rows = self.spark.createDataFrame(missed.collect(), missed.schema)  # ``recent`` rows at most
        n = rows.count()
        if n:
            apply(self._read("documents", DOCUMENTS).drop("batch").join(rows.select("scene", "run", "revision"), ["scene", "run", "revision"], "left_semi"))
            rows.select("scene", "run").write.mode("append").parquet(f"{self.path}/epilogues")
        return n
