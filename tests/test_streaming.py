"""Streams fed file by file, against the same operators run by hand."""

import pytest
from pyspark.errors import PySparkException, StreamingQueryException

from strandline.streaming import state, windows


def stream(spark, tmp_path, schema, batches, build, mode="append"):
    src = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        return spark.sql(f"SELECT * FROM {name}").collect()
    finally:
        q.stop()


def test_speeds_across_batches(spark, tmp_path):
    schema = "track_id bigint, event_id bigint, t double, x double, z double"
    got = stream(spark, tmp_path, schema, [[(1, 1, 0.0, 0.0, 0.0), (1, 2, 0.5, 3.0, 4.0)], [(1, 3, 1.0, 3.0, 4.0), (1, 4, 5.0, 0.0, 0.0)]], state.speeds)
    assert {(r["event_id"], r["speed"]) for r in got} == {(2, 10.0), (3, 0.0)}


def test_falling_time_is_an_error(spark, tmp_path):
    schema = "track_id bigint, event_id bigint, t double, x double, z double"
    with pytest.raises((StreamingQueryException, PySparkException)):
        stream(spark, tmp_path, schema, [[(1, 1, 2.0, 0.0, 0.0)], [(1, 2, 1.0, 0.0, 0.0)]], state.speeds)


def test_progress(spark, tmp_path):
    schema = "job bigint, event_id bigint, t double, phase string, done bigint, total bigint"
    rows = [[(1, 1, 0.0, "a", 0, 9), (1, 2, 0.4, "a", 1, 9), (1, 3, 0.8, "b", 2, 9)], [(1, 4, 1.5, "b", 3, 9), (1, 5, 1.9, "b", 4, 9), (1, 6, 2.0, "b", 9, 9)]]
    assert {r["event_id"] for r in stream(spark, tmp_path, schema, rows, state.coalesced_progress)} == {1, 3, 5, 6}


def test_claims(spark, tmp_path):
    schema = "job bigint, event_id bigint, t double, owner string, kind string"
    rows = [[(1, 1, 0.0, "a", "claim"), (1, 2, 10.0, "b", "claim"), (1, 3, 20.0, "a", "beat")], [(1, 4, 50.0, "b", "claim"), (1, 5, 51.0, "a", "done"), (1, 6, 60.0, "b", "done"), (1, 7, 99.0, "a", "claim")]]
    got = {r["event_id"]: r["verdict"] for r in stream(spark, tmp_path, schema, rows, state.claims)}
    assert got == {1: "granted", 2: "held", 3: "renewed", 4: "granted", 5: "lost", 6: "finished", 7: "finished"}


def test_late_rows_are_dropped(spark, tmp_path):
    import datetime as d

    at = lambda m: d.datetime(2024, 1, 1, 0, m)
    schema = "id bigint, ts timestamp, key string, value double"
    rows = [[(1, at(0), "k", 1.0), (2, at(1), "k", 2.0)], [(3, at(40), "k", 4.0)], [(6, at(41), "k", 0.0)], [(4, at(2), "k", 8.0)], [(5, at(59), "k", 1.0)]]  # the watermark counts from the batch after the next
    got = stream(spark, tmp_path, schema, rows, lambda s: windows.tumbling(s, "key", "10 minutes", "5 minutes"))
    assert {(r["started"].minute, r["n"], r["total"]) for r in got} == {(0, 2, 3.0), (40, 2, 4.0)}


def test_windows_on_batches(spark):
    import datetime as d

    at = lambda m: d.datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame([(1, at(0), "k", 1.0), (2, at(3), "k", 5.0), (3, at(30), "k", 5.0)], "id bigint, ts timestamp, key string, value double")
    assert windows.sessions(df, "key", "5 minutes", "1 minute").count() == 2
    assert {r["id"] for r in windows.best_per_bin(df, "key", "10 minutes", "1 minute").collect()} == {2, 3}
    assert windows.sliding(df, "key", "10 minutes", "5 minutes", "1 minute").count() == 4
