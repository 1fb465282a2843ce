"""Several passes over one event: repeated segments, the reference pass, identities fused over all of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window


from .solve import warp


@F.pandas_udf(DoubleType())
def _warped(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([warp(np.asarray(x, dtype=float), np.asarray(y, dtype=float))[0] for x, y in zip(a, b)])


def least_warp(a: Column, b: Column) -> Column:
    """No warping of two series costs less: each element meets one of the other series at least, and that lies
    within its range; the ends meet each other."""
    beyond = lambda v, low, high: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.greatest(F.lit(0.0), x - high, low - x))
    one, other = beyond(a, F.array_min(b), F.array_max(b)), beyond(b, F.array_min(a), F.array_max(a))
    first, last = F.abs(F.element_at(a, 1) - F.element_at(b, 1)), F.abs(F.element_at(a, -1) - F.element_at(b, -1))
    ends = F.when((F.size(a) > 1) | (F.size(b) > 1), first + last).otherwise(first)
    return F.greatest(one, other, ends) / (F.size(a) + F.size(b))


def replays(segments: DataFrame, limit: float = 0.095) -> DataFrame:
    """Role of each segment within its group: (owner, grp, id, variant, role, cost, confidence).

    ``segments``: owner, grp, id, start, v (its motion as an array). In order of start, then id, the first is
    the original; one whose motion warps onto an earlier segment's for at most ``limit`` (over both lengths) is
    a replay, with the least cost, and the others are continuations. Pairs that a lower bound puts over the
    limit are never warped. A null or empty series is like no other. Variants count from 0.
    """
    order = Window.partitionBy("owner", "grp").orderBy("start", "id")
    s = segments.withColumn("variant", F.row_number().over(order) - 1)
    known = s.where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))).withColumn("v", F.col("v").cast("array<double>"))
    before = known.select("owner", "grp", F.col("variant").alias("variant_b"), F.col("v").alias("b"))
    after = known.where("variant > 0").select("owner", "grp", "id", "variant", F.col("v").alias("a"))
    pairs = after.join(before, ["owner", "grp"]).where((F.col("variant_b") < F.col("variant")) & (least_warp(F.col("a"), F.col("b")) <= limit + 1e-12))
    best = pairs.withColumn("cost", _warped("a", "b")).where(F.col("cost") <= limit).groupBy("owner", "grp", "variant").agg(F.min("cost").alias("cost"))
    out = s.select("owner", "grp", "id", "variant").join(best, ["owner", "grp", "variant"], "left")
    role = F.when(F.col("variant") == 0, "original").when(F.col("cost").isNotNull(), "replay").otherwise("continuation")
    sure = F.when(role == "replay", F.greatest(F.lit(0.55), F.least(F.lit(0.95), 1 - F.col("cost") / 0.16))).when(role == "continuation", 0.55)
    return out.select("owner", "grp", "id", "variant", role.alias("role"), "cost", F.round(sure, 3).alias("confidence"))


def reference_passes(passes: DataFrame) -> DataFrame:
    """(match, reference): the pass of the best quality, the first in order (seq) on a tie; unknown quality is the least."""
    rank = F.struct((-F.coalesce("quality", F.lit(-1.0))).alias("q"), "seq", "pass")
    return passes.groupBy("match").agg(F.min(rank).alias("r")).select("match", F.col("r.pass").alias("reference"))


def usable_alignment(passes: DataFrame) -> Column:
    """Overlaps the reference, surely enough (less is asked of a manual one), on two anchors at least."""
    least = F.when(F.coalesce("manual", F.lit(False)), 0.50).otherwise(0.65)
    return F.coalesce(F.col("overlap") & (F.col("confidence") >= least) & (F.col("anchors") >= 2), F.lit(False))


def fuse_passes(people: DataFrame, passes: DataFrame, margin: float = 0.08) -> DataFrame:
    """Every person of every pass with the identity it has over all of them: (match, pass, id, fused, state, score, signals).

    ``people``: match, pass, id, team, role, external, number, conflict; ``passes``: match, pass, seq, quality,
    overlap, confidence, manual, anchors. People of passes that are aligned with the reference are linked with
    its people by an external player (1.0) or a number (0.9) they share, if nothing known of them differs,
    neither has a conflict, and both or neither are bound to a player. A link is accepted if it is the best of
    both its ends by ``margin``; other people with links are for review. ``state``: reference, linked,
    review, alone, or unaligned. Without a link the id is put under a name of its pass.
    """
    reference = reference_passes(passes)
    aligned = passes.join(reference, "match").where((F.col("pass") != F.col("reference")) & usable_alignment(passes)).select("match", "pass")
    names = ["id", "team", "role", "external", "number", "conflict"]
    kept = people.join(reference, "match")
    ours = kept.where(F.col("pass") == F.col("reference")).select("match", *(F.col(c).alias(f"r_{c}") for c in names))
    theirs = people.join(aligned, ["match", "pass"]).select("match", "pass", *names)
    agree = lambda c: F.coalesce(F.col(c) == F.col(f"r_{c}"), F.lit(True))
    calm = ~F.coalesce("conflict", F.lit(False)) & ~F.coalesce("r_conflict", F.lit(False))
    same = lambda c: F.coalesce(F.col(c) == F.col(f"r_{c}"), F.lit(False))
    by_player = theirs.join(ours, (theirs["match"] == ours["match"]) & (F.col("external") == F.col("r_external"))).drop(ours["match"])
    by_number = theirs.join(ours, (theirs["match"] == ours["match"]) & (F.col("number") == F.col("r_number")) & F.col("external").isNull() & F.col("r_external").isNull()).drop(ours["match"])
    links = by_player.unionByName(by_number).where(calm & agree("team") & agree("role") & agree("number"))
    score = F.when(same("external"), 1.0).otherwise(0.9)
    signals = F.concat_ws(",", F.when(same("external"), "external-player-match"), F.when(same("number"), "reliable-jersey-match"))
    links = links.select("match", "pass", "id", "r_id", score.alias("score"), signals.alias("signals"))
    for side in ("id", "r_id"):
        w = Window.partitionBy("match", "pass", side)
        links = links.withColumn(f"best_{side}", F.max("score").over(w)).withColumn(f"near_{side}", F.sum((F.col(f"best_{side}") - F.col("score") < margin).cast("int")).over(w))
    clear = lambda side: (F.col("score") == F.col(f"best_{side}")) & (F.col(f"near_{side}") == 1)
    links = links.withColumn("accepted", clear("id") & clear("r_id"))
    told = links.groupBy("match", "pass", "id").agg(F.max(F.when(F.col("accepted"), F.struct("r_id", "score", "signals"))).alias("link"))
    rows = kept.join(aligned.withColumn("aligned", F.lit(True)), ["match", "pass"], "left").join(told.withColumn("some", F.lit(True)), ["match", "pass", "id"], "left")
    is_reference = F.col("pass") == F.col("reference")
    state = F.when(is_reference, "reference").when(F.col("aligned").isNull(), "unaligned").when(F.col("link").isNotNull(), "linked").when(F.col("some"), "review").otherwise("alone")
    own = F.concat(F.lit("angle-"), F.substring(F.sha2(F.col("pass").cast("string").cast("binary"), 256), 1, 10), F.lit(":person:"), F.col("id").cast("string"))
    fused = F.when(is_reference, F.col("id").cast("string")).when(F.col("link").isNotNull(), F.col("link.r_id").cast("string")).otherwise(own)
    return rows.select("match", "pass", "id", fused.alias("fused"), state.alias("state"), "link.score", "link.signals")


def finalized(people: DataFrame, passes: DataFrame, fused: DataFrame) -> DataFrame:
    """What a match comes to over its passes: its reference and quality, passes ready and aligned, and people in
    all, fused, linked and for review."""
    best = reference_passes(passes)
    aligned = passes.join(best, "match").withColumn("with_it", (F.col("pass") != F.col("reference")) & usable_alignment(passes))
    of_passes = aligned.groupBy("match").agg(F.first("reference").alias("reference"), F.max("quality").alias("quality"), F.count("*").alias("passes"), F.count_if("with_it").alias("aligned"))
    of_people = fused.groupBy("match").agg(F.count("*").alias("people"), F.countDistinct("fused").alias("identities"), F.count_if(F.col("state") == "linked").alias("linked"), F.count_if(F.col("state") == "review").alias("review"))
    return of_passes.join(of_people, "match", "left").fillna(0, ["people", "identities", "linked", "review"])
