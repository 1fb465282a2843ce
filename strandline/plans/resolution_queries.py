"""Queries of identity resolution: vectors are tracklets of scenes of forty, their labels the people seen."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolution as R
from ..sources import proxies as P
from .registry import query


def tracklets(spark, sf):
    """Every vector as a tracklet; what is known of its person differs from tracklet to tracklet."""
    e = P.read(spark, sf, "embeddings").where("vec_id IS NOT NULL AND size(embedding) >= 48")
    at = "(vec_id % 40)"
    # Appearance: the label's own direction beside a stretch of the vector.
    look = lambda first: f"concat(transform(slice(embedding, {first}, 16), c -> double(c)), transform(sequence(0, 9), j -> if(j = label, 1.6D, 0D)))"
    said = {
        "scene": "vec_id div 40", "id": "concat('t', lpad(vec_id, 12, '0'))", "s": f"{at} * 0.7D", "e": f"{at} * 0.7D + 0.2D + (vec_id % 3) * 0.6D", "n": "int(vec_id % 25)", "manual": "if(vec_id % 19 = 0, concat('m', label), null)",
        "team": "if(vec_id % 5 > 0, string(label % 2), null)", "role": "if(vec_id % 7 > 2, if(label = 0, 'keeper', 'player'), null)", "external": "if(vec_id % 9 = 0, concat('p', label), null)",
        "shirt": "if(vec_id % 4 = 0, string(label + 1), null)", "shirt_conf": "0.5D + (vec_id % 6) / 10D", "shirt_n": "int(vec_id % 4)", "mean": look(1), "samples": f"array({look(1)}, {look(17)}, {look(33)})",
        "sx": "double(label * 9 + vec_id % 3)", "sz": "double(label * 5)", "su": "0.5D", "ex": "double(label * 9)", "ez": "double(label * 5 + vec_id % 2)", "eu": "0.5D",
        "shirt_sure": "vec_id % 31 = 0", "team_sure": "vec_id % 6 = 0", "role_sure": "vec_id % 8 = 0", "confirmed": "vec_id % 53 = 0", "excluded": "vec_id % 43 = 0",
    }
    return e.select(*(F.expr(v).alias(k) for k, v in said.items()))


def apart(spark, sf):
    """Human decisions: a tracklet and the one ten places on are two people."""
    e = P.read(spark, sf, "embeddings").where("vec_id % 10 = 3 AND vec_id % 40 < 30")
    return e.selectExpr("vec_id div 40 AS scene", "concat('t', lpad(vec_id, 12, '0')) AS a", "concat('t', lpad(vec_id + 10, 12, '0')) AS b")


@query()
def resolved_identities(spark, sf):
    found = R.resolve(tracklets(spark, sf), apart(spark, sf))
    return found.identities.select("scene", "identity", F.concat_ws(",", "tracklets").alias("tracklets"), "status", "source", "confidence", "team", "shirt", "n")


@query()
def resolution_edges(spark, sf):
    found = R.resolve(tracklets(spark, sf), apart(spark, sf))
    return found.edges.select("scene", "pred", "succ", "state", "score", "source", F.concat_ws(",", "reasons").alias("reasons"), "gap")
