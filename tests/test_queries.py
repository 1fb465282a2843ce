"""Every query with SQL against DuckDB on the smallest tables, and properties of the plans."""

import ast
import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import strandline.plans.catalogue as catalogue
from strandline.operators import series
from strandline.sources import proxies

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: These solve one small problem per frame in Python; at this size a few thousand frames.
SLOW = {"box_suppression", "roster_assignment_abstain", "iou_optimal_match_counts", "detection_prf"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list:
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return None
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(one, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - SLOW))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scan_is_pruned_and_pushed(spark):
    df = spark.read.parquet(f"{SF}/events.parquet").where("user_id = 3").select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "user_id" in plan.split("PushedFilters")[1] and "props" not in plan


def test_one_shuffle_by_track(spark):
    plan = series.state_labels(proxies.points(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_order_and_partitions_do_not_matter(spark):
    p = proxies.points(spark, SF)
    a = plain(series.splice_chains(p).toPandas())
    b = plain(series.splice_chains(p.orderBy(F.rand(3)).repartition(7)).toPandas())
    assert a == b


def test_only_the_entry_knows_the_corpus_package():
    root = Path(__file__).parent.parent
    for f in (root / "strandline").rglob("*.py"):
        if "llm" in f.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n for n in names), f
