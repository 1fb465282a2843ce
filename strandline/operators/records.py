"""Operators over records: stable ids, audits, latest versions, bounded reads, lineups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id


def occurrence_ids(rows: DataFrame, signature: list[str], order: list[str], length: int) -> DataFrame:
    """Adds ``k``, how many rows of the same signature came before, and an id of both."""
    w = Window.partitionBy(*signature).orderBy(*order)
    out = rows.withColumn("k", (F.row_number().over(w) - 1).cast("long"))
    return out.withColumn("id", stable_id(*[F.col(c) for c in signature], F.col("k"), length=length))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def forbidden_transitions(rows: DataFrame, by: str, order: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Counts of neighbouring states that are not in the table of allowed pairs."""
    before = F.lag(state).over(Window.partitionBy(by).orderBy(*order))
    steps = rows.select(before.alias("before"), F.col(state).alias("after")).where(F.col("before").isNotNull())
    table = rows.sparkSession.createDataFrame(allowed, "before string, after string")
    return steps.groupBy("before", "after").agg(F.count("*").alias("n")).join(table, ["before", "after"], "left_anti")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: an aggregate, not a sort."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("b"))
    return best.select(*key, *[F.col(f"b.{c}").alias(c) for c in rest])


def valid_prefix(rows: DataFrame, by: str, order: list[str], ok: Column) -> DataFrame:
    """Each key's rows before the first that is not ok."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("bad_", F.sum((~ok).cast("int")).over(w)).where("bad_ = 0").drop("bad_")


def series_window(points: DataFrame, start: float, end: float, entity: Column | None = None) -> DataFrame:
    """Rows within a bounded time window; rows without a time pass."""
    out = points.where(F.col("t").isNull() | F.col("t").between(start, end))
    return out if entity is None else out.where(entity)


def lineup(bundles: DataFrame) -> DataFrame:
    """Players of starters and substitutes as rows, the first mention of a player wins.

    ``bundles``: match_id, lineups array<struct<team, starters array<struct<id,name,number>>, substitutes same>>.
    """
    teams = bundles.select("match_id", F.posexplode("lineups").alias("team_order", "l"))
    parts = [teams.select("match_id", "team_order", F.col("l.team").alias("team"), F.lit(role).alias("role"), F.lit(i).alias("role_order"), F.posexplode(f"l.{field}").alias("lineup_order", "p")) for i, (role, field) in enumerate((("starter", "starters"), ("substitute", "substitutes")))]
    rows = parts[0].unionByName(parts[1]).select("match_id", "team", "role", "lineup_order", "team_order", "role_order", F.col("p.id").alias("player_id"), F.col("p.name").alias("name"), F.col("p.number").alias("number"))
    first = Window.partitionBy("match_id", "player_id").orderBy("team_order", "role_order", "lineup_order")
    return rows.withColumn("k_", F.row_number().over(first)).where("k_ = 1").drop("k_", "team_order", "role_order")


def shirt_conflicts(players: DataFrame) -> DataFrame:
    """Numbers that two players of a team wear."""
    return players.where(F.col("number").isNotNull()).groupBy("match_id", "team", "number").agg(F.countDistinct("player_id").alias("n")).where("n > 1")


def compare_and_set(current: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    """Writes whose expected revision is the stored one; of several for a key the first by write_id."""
    ok = writes.join(current.select(key, F.col("revision").alias("stored_")), key, "left").where(F.coalesce("stored_", F.lit(0)) == F.col("expected"))
    first = Window.partitionBy(key).orderBy("write_id")
    return ok.withColumn("k_", F.row_number().over(first)).where("k_ = 1").select(key, "write_id", (F.col("expected") + 1).alias("revision"))
