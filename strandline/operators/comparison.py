"""Comparing what two detectors saw, and checking what an identity model says of labelled crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import norm

#: Heights in pixels at which a stratum begins, and where the last ends.
HEIGHTS = (0, 25, 40, 70)
TALLEST = 10_000


def observation_pairs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Pairs of two models' observations (frame, id, x, y, height) that may be the same: frame, b_id, c_id,
    ratio (distance by the limit of the smaller height). The join is on the frame."""
    a = baseline.select("frame", F.col("id").alias("b_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("height").alias("ah"))
    b = candidate.select("frame", F.col("id").alias("c_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("height").alias("bh"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    limit = F.greatest(F.lit(14.0), F.least("ah", "bh") * 0.72)
    return a.join(b, "frame").select("frame", "b_id", "c_id", (F.sqrt(dx * dx + dy * dy) / limit).alias("ratio")).where("ratio <= 1")


def unpaired(rows: DataFrame, matches: DataFrame, id_: str) -> DataFrame:
    """``rows`` with ``paired``: whether (frame, id) is in the one-to-one ``matches``."""
    found = matches.select("frame", F.col(id_).alias("id"), F.lit(True).alias("paired"))
    return rows.join(found, ["frame", "id"], "left").withColumn("paired", F.coalesce("paired", F.lit(False)))


def comparison_counts(baseline: DataFrame, candidate: DataFrame, matches: DataFrame, by: str) -> DataFrame:
    """Per ``by``: shared observations, those of one model alone, those of them inside, and the gain inside.

    Observations have frame, id, inside and ``by``; ``matches``: frame, b_id, c_id. A scene that only one
    model saw is there too, with zeros for the other.
    """
    a = unpaired(baseline, matches, "b_id").select(by, "paired", "inside", F.lit(True).alias("old"))
    b = unpaired(candidate, matches, "c_id").select(by, "paired", "inside", F.lit(False).alias("old"))
    alone, inside = ~F.col("paired"), F.coalesce("inside", F.lit(False))
    return (
        a.unionByName(b)
        .groupBy(by)
        .agg(
            F.count_if(F.col("old") & F.col("paired")).alias("shared"),
            F.count_if(F.col("old") & alone).alias("baseline_only"),
            F.count_if(~F.col("old") & alone).alias("candidate_only"),
            F.count_if(F.col("old") & alone & inside).alias("baseline_only_inside"),
            F.count_if(~F.col("old") & alone & inside).alias("candidate_only_inside"),
        )
        .withColumn("inside_gain", F.col("candidate_only_inside") - F.col("baseline_only_inside"))
    )


def height_stratum(height: Column) -> Column:
    out = F.when(height.isNull() | F.isnan(height) | (height < HEIGHTS[0]) | (height >= TALLEST), "unknown")
    for low, high in zip(HEIGHTS, HEIGHTS[1:]):
        out = out.when(height < high, f"{low}-{high}px")
    return out.otherwise(f"{HEIGHTS[-1]}-infpx")


def shadow_strata(baseline: DataFrame, challenger: DataFrame, matches: DataFrame) -> DataFrame:
    """Agreement of a challenger that runs beside a detector, by the boxes' height, and over all.

    Boxes: frame, id, h; only frames that both saw count. ``matches``: frame, b_id, c_id, one to one. Gives
    stratum ('all' over all), frames, baseline, baseline_matched, challenger, challenger_only, matched_ratio
    (null without baseline boxes).
    """
    a = unpaired(baseline.select("frame", "id", "h"), matches, "b_id").select("frame", "h", "paired", F.lit(True).alias("old"))
    b = unpaired(challenger.select("frame", "id", "h"), matches, "c_id").select("frame", "h", "paired", F.lit(False).alias("old"))
    both = baseline.select("frame").distinct().join(challenger.select("frame").distinct(), "frame")
    rows = a.unionByName(b).join(both, "frame", "left_semi").withColumn("stratum", height_stratum(F.col("h").cast("double")))
    counted = rows.rollup("stratum").agg(
        F.countDistinct("frame").alias("frames"),
        F.count_if("old").alias("baseline"),
        F.count_if(F.col("old") & F.col("paired")).alias("baseline_matched"),
        F.count_if(~F.col("old")).alias("challenger"),
        F.count_if(~F.col("old") & ~F.col("paired")).alias("challenger_only"),
    )
    ratio = F.round(F.try_divide(F.col("baseline_matched").cast("double"), F.col("baseline")), 3)
    return counted.withColumns({"stratum": F.coalesce("stratum", F.lit("all")), "matched_ratio": ratio})


def embedding_problems(crops: DataFrame, dimension: int, tolerance: float = 0.01) -> DataFrame:
    """What is wrong with each crop's embedding: adds ``norm_error`` and ``problem``, null for a good one.

    ``crops``: usable (by the worker), embedding array<double>. Null embeddings have no dimension.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    error = F.abs(norm(v) - 1)
    measured = F.coalesce("usable", F.lit(False)) & (F.coalesce(F.size(v), F.lit(-1)) == dimension) & finite
    problem = (
        F.when(~F.coalesce("usable", F.lit(False)), "worker-marked-unusable")
        .when(v.isNull() | (F.size(v) != dimension), "embedding-dimension-invalid")
        .when(~finite, "embedding-non-finite")
        .when(norm(v) <= 1e-12, "embedding-zero")
        .when(error > tolerance, "embedding-not-normalized")
    )
    return crops.withColumns({"norm_error": F.when(measured, error), "problem": problem})


def role_confusion(crops: DataFrame, roles: list[str]) -> DataFrame:
    """(expected, predicted, n): crops by their role and the one predicted; a prediction that is unusable
    or no role is ``__abstain__``."""
    known = F.coalesce("usable", F.lit(False)) & F.coalesce(F.col("predicted").isin(roles), F.lit(False))
    return crops.groupBy(F.col("role").alias("expected"), F.when(known, F.col("predicted")).otherwise("__abstain__").alias("predicted")).agg(F.count("*").alias("n"))


def identity_contract(crops: DataFrame, roles: list[str], dimension: int, least_usable: float, least_accuracy: float, tolerance: float = 0.01) -> DataFrame:
    """One row: total, valid, usable_ratio, worst_norm_error, role_accuracy, and whether the contract, the
    usable share and the roles pass. Without crops nothing passes."""
    rows = embedding_problems(crops, dimension, tolerance)
    right = F.coalesce(F.col("usable") & F.col("predicted").isin(roles) & (F.col("predicted") == F.col("role")), F.lit(False))
    sums = rows.agg(F.count("*").alias("total"), F.count_if(F.col("problem").isNull()).alias("valid"), F.max("norm_error").alias("worst_norm_error"), F.count_if(right).alias("right"))
    share, accuracy = F.try_divide(F.col("valid").cast("double"), F.col("total")), F.try_divide(F.col("right").cast("double"), F.col("total"))
    return sums.select(
        "total",
        "valid",
        share.alias("usable_ratio"),
        "worst_norm_error",
        accuracy.alias("role_accuracy"),
        ((F.col("total") > 0) & (F.col("valid") == F.col("total"))).alias("contract_passes"),
        F.coalesce(share >= least_usable, F.lit(False)).alias("usable_passes"),
        F.coalesce(accuracy >= least_accuracy, F.lit(False)).alias("roles_pass"),
    )
