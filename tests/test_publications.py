"""Reservoirs in state against the batch, and publications under replays and failures."""

import datetime as dt
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.streaming import state
from strandline.streaming.publish import Publications, verdicts

SAMPLES = "track_id bigint, event_id bigint, ts timestamp, quality double, fingerprint string"


def batch_reservoir(samples, width, keep, gap, most):
    """The same choice by windows over whole tables."""
    t = samples.withColumn("t", F.unix_micros("ts") / 1e6).where(F.col("quality").isNotNull())
    first = F.row_number().over(Window.partitionBy("track_id", F.coalesce("fingerprint", F.concat(F.lit("\0"), "event_id"))).orderBy("t", "event_id"))
    t = t.withColumn("k", first).where("k = 1").withColumn("bin", F.floor(F.col("t") / width))
    for by in (["track_id", "bin"], ["track_id"]):
        t = t.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("quality"), "event_id"))).where(F.col("k") <= (1 if "bin" in by else keep))
    out = set()
    for track, rows in t.toPandas().groupby("track_id"):
        taken = []
        for r in rows.sort_values(["quality", "t", "event_id"], ascending=[False, True, True]).itertuples():
            if len(taken) < most and all(abs(r.t - x) >= gap for _, x in taken):
                taken.append((r.event_id, r.t))
        out |= {(track, i) for i, _ in taken}
    return out


@pytest.mark.parametrize("cuts", [1, 3, 8])
def test_reservoir_equals_the_batch_however_it_is_cut(spark, tmp_path, cuts):
    r = np.random.default_rng(4)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = []
    for i in range(240):
        rows.append((int(r.integers(0, 4)), i, start + dt.timedelta(milliseconds=int(i * 40 + r.integers(0, 40))), None if i % 31 == 0 else float(r.integers(0, 30)) / 30, f"f{r.integers(0, 150)}" if i % 7 else None))
    rows.sort(key=lambda x: x[2])
    config = {"width": 0.25, "keep": 9, "gap": 0.45, "most": 5}
    want = batch_reservoir(spark.createDataFrame(rows, SAMPLES), **config)
    src = str(tmp_path / "in")
    # Rows of a later track move the watermark until all others have been idle.
    ends = [(99, 1000 + k, start + dt.timedelta(seconds=60 + 60 * k), 0.5, None) for k in range(3)]
    for part in [*np.array_split(np.arange(len(rows)), cuts), *ends]:
        some = [part] if isinstance(part, tuple) else [rows[k] for k in part]
        spark.createDataFrame(some, SAMPLES).coalesce(1).write.mode("append").parquet(src)
    read = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(src)
    name = f"reservoir_{cuts}"
    q = state.reservoir(read, "30 seconds", **config).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = [(x["track_id"], x["event_id"]) for x in spark.sql(f"SELECT * FROM {name} WHERE track_id < 99").collect()]
    finally:
        q.stop()
    assert len(got) == len(set(got)) and set(got) == want and len(want) == 20


BATCH = "scene string, run string, fingerprint string, owner string, at double, seq bigint, expected bigint, status string, body string"


def tables(spark):
    jobs = spark.createDataFrame([("s1", "r1", "f", "processing"), ("s2", "r2", "f", "processing"), ("s3", "r3", "f", "queued"), ("s4", "r4", "f", "processing"), ("s5", "r5", "f", "processing")], "scene string, run string, fingerprint string, status string")
    leases = spark.createDataFrame([("s1", "o", 100.0), ("s2", "o", 100.0), ("s3", "o", 100.0), ("s4", "o", 5.0)], "scene string, owner string, expires double")
    return jobs, leases


def publication(scene, run, seq, at=10.0, fingerprint="f", owner="o", expected=0, status="succeeded"):
    return (scene, run, fingerprint, owner, at, seq, expected, status, f"body {seq}")


def test_verdicts(spark):
    rows = [
        publication("s1", "r1", 1, at=11.0), publication("s1", "r1", 2, at=10.5), publication("s2", "old", 3), publication("s2", "r2", 4, fingerprint="g"), publication("s2", "r2", 5, owner="p"), publication("s2", "r2", 6, expected=7),
        publication("s3", "r3", 7), publication("s4", "r4", 8), publication("s4", "r4", 9, at=5.0), publication("s5", "r5", 10), publication("s9", "r9", 11), publication("s2", "r2", 12, status="running"), publication("s2", None, 13, fingerprint=None),
    ]
    none = spark.createDataFrame([], "scene string, revision bigint, run string")
    got = {r["seq"]: (r["verdict"], r["revision"]) for r in verdicts(spark.createDataFrame(rows, BATCH), *tables(spark), none).collect()}
    assert got == {1: ("late", None), 2: ("accepted", 1), 3: ("other-run", None), 4: ("other-input", None), 5: ("lease-lost", None), 6: ("stale-revision", None), 7: ("not-processing", None), 8: ("lease-lost", None), 9: ("lease-lost", None), 10: ("lease-lost", None), 11: ("other-run", None), 12: ("not-terminal", None), 13: ("other-run", None)}


def files(path):
    return sorted((str(p.relative_to(path)), p.stat().st_mtime_ns) for p in Path(path).rglob("*.parquet"))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    store = Publications(spark, f"file://{tmp_path}/store")
    jobs, leases = tables(spark)
    batch = spark.createDataFrame([publication("s1", "r1", 1), publication("s2", "r2", 2)], BATCH)
    assert store.commit(batch, 0, jobs, leases)
    before = files(tmp_path)
    assert not store.commit(batch, 0, jobs, leases) and files(tmp_path) == before
    # In a later batch the same run is published already.
    assert store.commit(batch, 1, jobs, leases)
    assert {r["verdict"] for r in store.ledger().where("batch = 1").collect()} == {"published-already"}
    assert sorted((r["scene"], r["revision"], r["body"]) for r in store.documents().collect()) == [("s1", 1, "body 1"), ("s2", 1, "body 2")]


def test_a_stream_that_fails_half_way_ends_as_one_that_does_not(spark, tmp_path):
    jobs, leases = tables(spark)
    src = f"{tmp_path}/in"
    for rows in ([publication("s1", "r1", 1), publication("s3", "r3", 2)], [publication("s2", "r2", 3, at=12.0), publication("s2", "r2", 4)], [publication("s1", "r1", 5, expected=1)]):
        spark.createDataFrame(rows, BATCH).coalesce(1).write.mode("append").parquet(src)
    fail = {1}

    def run(name, failing):
        store = Publications(spark, f"file://{tmp_path}/{name}")

        def once(batch, batch_id):
            def written():
                if failing and batch_id in fail:
                    fail.remove(batch_id)
                    raise RuntimeError("lost")

            store.commit(batch, batch_id, jobs, leases, written)

        def start():
            q = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(src).writeStream.foreachBatch(once).option("checkpointLocation", f"{tmp_path}/cp-{name}").start()
            try:
                q.processAllAvailable()
            finally:
                q.stop()

        if failing:
            with pytest.raises(Exception, match="lost"):
                start()
            # The documents of the failed batch are written, and not there.
            assert store._is("documents/batch=1") and not store.committed(1) and {r["scene"] for r in store.documents().collect()} == {"s1"}
        start()
        return sorted(map(tuple, store.ledger().collect()), key=str), sorted(map(tuple, store.documents().collect()))

    whole, broken = run("whole", False), run("broken", True)
    assert whole == broken and not fail and [d[0] for d in whole[1]] == ["s1", "s2"]


def test_epilogues_are_repeated_until_noted(spark, tmp_path):
    store = Publications(spark, f"file://{tmp_path}/store")
    jobs, leases = tables(spark)
    store.commit(spark.createDataFrame([publication("s1", "r1", 1), publication("s2", "r2", 2, status="failed")], BATCH), 0, jobs, leases)
    assert [r["run"] for r in store.missed_epilogues().collect()] == ["r1"] and store.missed_epilogues(0).count() == 0
    done = []

    def broken(docs):
        done.extend(r["run"] for r in docs.collect())
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.replay_epilogues(broken)
    assert store.replay_epilogues(lambda docs: done.extend(r["run"] for r in docs.collect())) == 1
    assert done == ["r1", "r1"] and store.missed_epilogues().count() == 0 and store.replay_epilogues(broken) == 0


def test_an_empty_store_and_batch(spark, tmp_path):
    store = Publications(spark, f"file://{tmp_path}/store")
    assert store.documents().count() == 0 and store.missed_epilogues().count() == 0
    assert store.commit(spark.createDataFrame([], BATCH), 0, *tables(spark)) and store.committed(0) and store.documents().count() == 0
