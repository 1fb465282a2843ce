"""Match records: provider fixtures, canonical ids, validation of manual bundles, actions at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id


def fixtures(raw: DataFrame) -> DataFrame:
    """Canonical fixtures from provider rows (provider, id, kickoff, status, league, season, home, away,
    home_score, away_score); date and HH:MM are kept as the provider wrote them."""
    return raw.select(
        stable_id(F.col("provider"), F.lit("event"), F.col("id")).alias("event_id"),
        F.concat_ws(" - ", "home", "away").alias("name"),
        F.substring("kickoff", 1, 10).alias("date"),
        F.when(F.length("kickoff") >= 16, F.substring("kickoff", 12, 5)).alias("time"),
        F.lower("status").alias("status"),
        "league",
        F.col("season").cast("string").alias("season"),
        "home_score",
        "away_score",
    )


def canonical_events(events: DataFrame, players: DataFrame, teams: DataFrame) -> DataFrame:
    """Timeline rows with provider ids of players and teams replaced by canonical ones; unknown ids become null."""
    p = players.select(F.col("provider_id").alias("p_"), F.col("id").alias("player"))
    q = players.select(F.col("provider_id").alias("q_"), F.col("id").alias("secondary"))
    t = teams.select(F.col("provider_id").alias("t_"), F.col("id").alias("team"))
    out = events.join(p, F.col("player_id") == F.col("p_"), "left").join(q, F.col("secondary_player_id") == F.col("q_"), "left").join(t, F.col("team_id") == F.col("t_"), "left")
    return out.select("id", "minute", "type", "player", "secondary", "team", "detail")


def bundle_problems(players: DataFrame, timeline: DataFrame, substitutions: DataFrame, least_starters: int = 11) -> DataFrame:
    """What is wrong with manual bundles: (match_id, problem, detail); no rows for a good one."""
    ids = players.select("match_id", F.col("id").alias("pid")).distinct()

    def unknown(rows: DataFrame, column: str, problem: str) -> DataFrame:
        named = rows.where(F.col(column).isNotNull()).select("match_id", F.col(column).alias("pid"))
        return named.join(ids, ["match_id", "pid"], "left_anti").select("match_id", F.lit(problem).alias("problem"), F.col("pid").alias("detail"))

    twice = players.groupBy("match_id", "id").count().where("count > 1").select("match_id", F.lit("duplicate-player").alias("problem"), F.col("id").alias("detail"))
    shirts = players.where(F.col("number").isNotNull()).groupBy("match_id", "team_id", "number").agg(F.countDistinct("id").alias("n")).where("n > 1")
    shirts = shirts.select("match_id", F.lit("duplicate-number").alias("problem"), F.concat_ws(":", "team_id", "number").alias("detail"))
    few = players.groupBy("match_id", "team_id").agg(F.count_if(F.col("lineup_role") == "starter").alias("n")).where(F.col("n") < least_starters)
    few = few.select("match_id", F.lit("few-starters").alias("problem"), F.col("team_id").alias("detail"))
    out = twice.unionByName(shirts).unionByName(few)
    for rows, column in ((timeline, "player_id"), (timeline, "secondary_player_id"), (substitutions, "player_out_id"), (substitutions, "player_in_id")):
        out = out.unionByName(unknown(rows, column, f"unknown-{column}"))
    return out.distinct()


def roster_quality(players: DataFrame) -> DataFrame:
    """Per match: teams, starters, keepers and numbers known."""
    return players.groupBy("match_id").agg(
        F.countDistinct("team_id").alias("teams"), F.count_if(F.col("lineup_role") == "starter").alias("starters"), F.count_if(F.lower("position").isin("g", "gk", "goalkeeper")).alias("keepers"), F.count("number").alias("numbered"), F.count("*").alias("players")
    )


def active_action(actions: DataFrame, by: str, time: Column) -> DataFrame:
    """The action of each key at a time: both ends count; manual and confirmed ones first, then
    confidence, the shorter, the later begun, the id. ``actions``: (by, id, start, stop, source, status, confidence)."""
    rank = F.when((F.col("source") == "manual") & (F.col("status") == "confirmed"), 4).when(F.col("source") == "manual", 3).when(F.col("status") == "confirmed", 2).otherwise(1)
    live = actions.where((F.col("status") != "rejected") & (F.col("start") <= time) & (time <= F.col("stop")))
    w = Window.partitionBy(by).orderBy(F.desc(rank), F.desc("confidence"), F.col("stop") - F.col("start"), F.desc("start"), "id")
    return live.withColumn("k_", F.row_number().over(w)).where("k_ = 1").drop("k_")
