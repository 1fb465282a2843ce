"""Evidence fusion: duplicates, time windows, capped top-k, votes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def best_per_fingerprint(rows: DataFrame, fingerprint: str = "hash", quality: str = "quality", tie: str = "id") -> DataFrame:
    """One row per fingerprint: the best quality, then the smallest id. A partial aggregate, no sort."""
    rest = [c for c in rows.columns if c not in (fingerprint, quality, tie)]
    best = rows.groupBy(fingerprint).agg(F.min(F.struct((-F.col(quality)).alias("q"), F.col(tie), *rest)).alias("b"), F.count("*").alias("copies"))
    return best.select(F.col(f"b.{tie}").alias(tie), fingerprint, (-F.col("b.q")).alias(quality), *[F.col(f"b.{c}").alias(c) for c in rest], "copies")


def reject_all_duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Only rows whose key occurs once."""
    once = rows.groupBy(key).count().where("count = 1").select(key)
    return rows.join(once, key, "left_semi")


def window_best_then_cap(readings: DataFrame, width: float, cap: int) -> DataFrame:
    """Best reading of each (tracklet, time window), then the ``cap`` best of a tracklet."""
    binned = readings.withColumn("bin", F.floor(F.col("t") / width).cast("long"))
    one = ranked(binned, ["tracklet", "bin"], [F.desc("conf"), F.col("t"), F.col("id")]).where("rank = 1").drop("rank")
    return ranked(one, ["tracklet"], [F.desc("conf"), F.col("t"), F.col("id")]).where(F.col("rank") <= cap)


@dataclass(frozen=True)
class VoteConfig:
    runner_share: float = 0.34
    margin: float = 0.20
    least_support: int = 2
    reliable: float = 0.80


def votes(readings: DataFrame, config: VoteConfig = VoteConfig()) -> DataFrame:
    """Per tracklet: the number with most weight, its share, its margin and the state of the vote."""
    sums = readings.groupBy("tracklet", "number").agg(F.sum("conf").alias("weight"), F.count("*").alias("support"), F.avg("conf").alias("mean"))
    total = F.sum("weight").over(Window.partitionBy("tracklet"))
    order = Window.partitionBy("tracklet").orderBy(F.desc(F.round("weight", 6)), "number")
    shares = sums.withColumn("share", F.col("weight") / total)
    shares = shares.withColumns({"rank": F.row_number().over(order), "runner": F.coalesce(F.lead("share").over(order), F.lit(0.0))})
    conflict = (F.col("runner") >= config.runner_share) | (F.col("share") - F.col("runner") < config.margin)
    confidence = F.least(F.lit(1.0), 0.6 * F.col("mean") + 0.4 * F.col("share"))
    state = F.when(conflict, "conflict").when((F.col("support") >= config.least_support) & (confidence >= config.reliable), "reliable").otherwise("provisional")
    return shares.where("rank = 1").select("tracklet", "number", "support", "share", (F.col("share") - F.col("runner")).alias("margin"), state.alias("state"))


def fused_votes(readings: DataFrame, canonical: Column, width: float, cap: int) -> DataFrame:
    """Tracklets first, then their canonical owner: chosen readings are summed again, with counts by number."""
    chosen = window_best_then_cap(readings, width, cap)
    tracklets = chosen.groupBy(canonical.alias("owner"), "tracklet", "number").agg(F.sum("conf").alias("weight"), F.count("*").alias("n"))
    owners = tracklets.groupBy("owner", "number").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"), F.countDistinct("tracklet").alias("tracklets"))
    return ranked(owners, ["owner"], [F.desc(F.round("weight", 6)), F.col("number")]).where("rank = 1").drop("rank")


def counter_maps(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Counts of a name's values as one map per key."""
    counts = rows.groupBy(by, name).count()
    return counts.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "count")))).alias("counts"))


def separated_top(rows: DataFrame, by: str, gap: float, cap: int) -> DataFrame:
    """Greedy choice by quality, then id: taken if at least ``gap`` from all taken, up to ``cap``."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("q"), F.col("event_id").alias("id"), F.col("t"))))
    taken = F.aggregate(
        "rows",
        F.array().cast("array<struct<q:double,id:bigint,t:double>>"),
        lambda kept, r: F.when((F.size(kept) < cap) & ~F.exists(kept, lambda k: F.abs(k["t"] - r["t"]) < gap), F.concat(kept, F.array(r))).otherwise(kept),
    )
    picked = rows.groupBy(by).agg(order.alias("rows")).select(by, F.posexplode(taken).alias("pos", "r"))
    return picked.select(by, (F.col("pos") + 1).alias("pick"), F.col("r.id").alias("event_id"), F.col("r.t").alias("t"))


def top_with_forced(rows: DataFrame, by: str, order: list, forced: Column, k: int) -> DataFrame:
    """The first k of each key and all forced rows, ranked again."""
    first = ranked(rows, [by], order, "first").where((F.col("first") <= k) | forced)
    return ranked(first, [by], order).drop("first")


def binned_reservoir(rows: DataFrame, by: str, width: float, cap: int) -> DataFrame:
    """Best of each time bin of a key, then the ``cap`` best bins."""
    best = ranked(rows.withColumn("bin", (F.col("t") / width).cast("long")), [by, "bin"], [F.desc("conf"), F.col("event_id")]).where("rank = 1").drop("rank")
    return ranked(best, [by], [F.desc("conf"), F.col("event_id")]).where(F.col("rank") <= cap)
