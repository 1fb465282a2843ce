"""Roll-ups of what resolving identities and projecting tracks did, one row per scene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quantile(values: Column, share: float) -> Column:
    return F.round(F.percentile(values, F.lit(share)), 6)


def reason_counts(rows: DataFrame, by: str, reasons: str) -> DataFrame:
    """(by, counts): a map from each reason to how often it is in the arrays of the key's rows."""
    each = rows.select(by, F.explode(reasons).alias("reason")).groupBy(by, "reason").agg(F.count("*").alias("n"))
    return each.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("counts"))


def resolver_diagnostics(tracklets: DataFrame, identities: DataFrame, edges: DataFrame, least_strong: int = 2) -> DataFrame:
    """Quality of one identity resolution per scene.

    ``tracklets``: scene, id, excluded, observations, identity (null where it got none); ``identities``: scene,
    status, conflict; ``edges``: scene, verdict (accepted, review, rejected), source, score, reasons,
    strong_left, strong_right. A scene without tracklets is absent; one without edges has zeros and null scores.
    ``digest`` is of its tracklets' ids in order, so equal inputs can be told.
    """
    verdict = lambda v: F.col("verdict") == v
    has = lambda word: F.coalesce(F.exists("reasons", lambda r: r.startswith(word)), F.lit(False))
    t = tracklets.groupBy("scene").agg(
        F.count("*").alias("tracklets"),
        F.count_if(~F.coalesce("excluded", F.lit(False))).alias("eligible"),
        F.sum("observations").alias("observations"),
        (F.count("identity") == F.count("*")).alias("all_preserved"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), "\n").cast("binary"), 256).alias("digest"),
    )
    i = identities.groupBy("scene").agg(F.count("*").alias("identities"), *[F.count_if(F.col("status") == s).alias(s) for s in ("resolved", "provisional", "excluded")], F.count_if(F.coalesce("conflict", F.lit(False))).alias("conflicts"))
    e = edges.groupBy("scene").agg(
        *[F.count_if(verdict(v)).alias(v) for v in ("accepted", "review", "rejected")],
        F.count_if(verdict("accepted") & (F.col("source") == "automatic")).alias("automatic"),
        F.count_if(verdict("accepted") & (F.col("source") == "manual")).alias("manual"),
        F.count_if(verdict("review") & has("ambiguous-")).alias("ambiguous"),
        F.count_if(verdict("accepted") & F.coalesce(F.array_contains("reasons", "strong-reid"), F.lit(False)) & (F.least("strong_left", "strong_right") >= least_strong)).alias("strong_both_ways"),
        _quantile(F.when(~verdict("rejected"), F.col("score")), 0.1).alias("score_p10"),
        _quantile(F.when(~verdict("rejected"), F.col("score")), 0.5).alias("score_p50"),
        _quantile(F.when(verdict("accepted"), F.col("score")), 0.1).alias("accepted_p10"),
        _quantile(F.when(verdict("review"), F.col("score")), 0.5).alias("review_p50"),
    )
    rejections = reason_counts(edges.where(verdict("rejected")), "scene", "reasons").withColumnRenamed("counts", "rejections")
    out = t.join(i, "scene", "left").join(e, "scene", "left").join(rejections, "scene", "left")
    counts = [c for c in (*i.columns, *e.columns) if c != "scene" and not c.endswith(("_p10", "_p50"))]
    return out.fillna(0, counts)


def projection_diagnostics(tracks: DataFrame, by: str = "scene") -> DataFrame:
    """Sums of the tracks' projection quality, the largest speeds, and how much was published.

    ``tracks``: raw, retained, discarded, speed_samples, violations, raw_violations, fragments,
    discarded_fragments, raw_speed, adjusted_speed (null: none), images, published, accepted, rejected,
    unprojected. Fragments count as discarded only where a track was split. Coverage is published by images
    and accepted by published, of at least one each.
    """
    split = F.col("fragments") > 1
    sums = [F.sum(c).alias(c) for c in ("raw", "retained", "discarded", "speed_samples", "violations", "raw_violations", "images", "published", "accepted", "rejected", "unprojected")]
    out = tracks.groupBy(by).agg(
        *sums,
        F.count_if(split).alias("split_tracks"),
        F.sum(F.when(split, F.col("discarded_fragments")).otherwise(0)).alias("discarded_fragments"),
        F.round(F.max("raw_speed"), 3).alias("raw_speed"),
        F.round(F.max("adjusted_speed"), 3).alias("adjusted_speed"),
    )
    share = lambda a, b: F.round(F.col(a).cast("double") / F.greatest(F.lit(1), F.col(b)), 3)
    return out.withColumns({"coverage": share("published", "images"), "metric_coverage": share("accepted", "published")})


#: Fixed keys of a progress record that a listing shows.
PROGRESS_KEYS = ("phase", "phaseIndex", "phaseCount", "label", "detail", "completed", "total", "phasePercent", "overallPercent", "elapsedSeconds", "etaSeconds", "updatedAt")


def compact_progress(progress: Column) -> Column:
    """The entries of a progress map that a listing shows; an empty map for null."""
    kept = F.map_filter(progress, lambda k, _: k.isin(*PROGRESS_KEYS))
    return F.coalesce(kept, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def scene_kind(title: Column, video: Column) -> Column:
    """What a scene was made from; ``video``: struct of filename, multi_pass, parent, segment, null without one."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    contains = lambda c, word: F.coalesce(F.lower(c).contains(word), F.lit(False))
    return (
        F.when(video.isNull() | contains(title, "smoke test") | contains(video["filename"], "smoke"), "demo")
        .when(F.coalesce(video["multi_pass"], F.lit(False)), "multi-pass")
        .when(filled(video["parent"]) | filled(video["segment"]), "segment")
        .otherwise("video")
    )
