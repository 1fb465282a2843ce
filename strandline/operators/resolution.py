"""Identity resolution of whole scene sets: from tracklets to identities, with every edge's verdict.

Stages, each one shuffle by its key: must-links become nodes, nodes that may follow each other are scored
as pairs of a scene, competing edges are demoted from both ends, every chain takes at most one next
node, and groups grow by falling score unless the evidence of a group would contradict itself. Human
decisions that two tracklets are apart stop the edge between them and any group that would hold both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import clamp, hypot
from ..functions.vector import cosine_distance, normalize
from .assign import hungarian
from .checkpoint import cut
from .graph import components
from .groups import Rows, each_group


@dataclass(frozen=True)
class ResolverConfig:
    """Limits and weights are fixed values of the model."""

    shirt_confidence: float = 0.80
    shirt_samples: int = 2
    strong_distance: float = 0.18
    review_distance: float = 0.30
    strong_sample_distance: float = 0.10
    strong_samples: int = 2
    accept: float = 0.78
    margin: float = 0.08
    gap_penalty: float = 0.20
    gap_penalty_most: float = 0.25
    speed: float = 12.0
    slack: float = 2.0
    epsilon: float = 1e-6


@dataclass(frozen=True)
class Resolution:
    """``members``: scene, id, identity. ``identities``: one row each, with its evidence. ``edges``: scene,
    pred, succ, state (accepted, review, rejected), score, source, reasons, gap."""

    members: DataFrame
    identities: DataFrame
    edges: DataFrame


def _usable(v: Column) -> Column:
    """The unit vector of a vector of finite numbers that is not all zero, else null."""
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when((F.size(v) > 0) & finite, normalize(v))


def _mean(vectors: Column) -> Column:
    """Sum of an array of (weight, vector) of one length, as a unit vector; null for an empty array."""
    add = lambda acc, x: F.when(acc.isNull(), F.transform(x["v"], lambda c: c * x["w"])).otherwise(F.zip_with(acc, x["v"], lambda a, c: a + c * x["w"]))
    return normalize(F.aggregate(vectors, F.lit(None).cast("array<double>"), add))


def nodes(tracklets: DataFrame) -> DataFrame:
    """One row per scene and must-link group (or tracklet without one), with what its members agree on.

    A value that members disagree on is null; ``conflicts`` names the disagreements that no link may carry.
    """
    t = tracklets.withColumns({"mean": _usable(F.col("mean")), "samples": F.filter(F.transform(F.coalesce("samples", F.array().cast("array<array<double>>")), _usable), lambda v: v.isNotNull())})
    own = F.when(F.size("samples") > 0, _mean(F.transform("samples", lambda v: F.struct(F.lit(1.0).alias("w"), v.alias("v")))))
    t = t.withColumn("mean", F.coalesce("mean", own)).withColumn("node", F.coalesce(F.concat(F.lit("manual:"), F.col("manual")), F.concat(F.lit("tracklet:"), F.col("id"))))
    agreed = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    one = lambda c: agreed(c).alias(c)
    many = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    sure = lambda c: F.when(F.col(f"{c}_sure"), F.col(c))
    dims = F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.concat(F.array(F.when(F.col("mean").isNotNull(), F.size("mean"))), F.transform("samples", lambda v: F.size(v)))))))
    members = F.sort_array(F.collect_list(F.struct("s", "e", "id", F.coalesce("n", F.lit(0)).alias("n"), "mean", "samples")))
    out = t.groupBy("scene", "node").agg(
        members.alias("members"), F.min("s").alias("s"), F.max("e").alias("e"), one("manual"), one("team"), one("role"), one("external"), one("shirt"),
        F.coalesce(F.max(F.when(F.col("shirt").isNotNull(), F.col("shirt_conf"))), F.lit(0.0)).alias("shirt_conf"), F.coalesce(F.sum(F.when(F.col("shirt").isNotNull(), F.col("shirt_n"))), F.lit(0)).alias("shirt_n"),
        F.max(F.coalesce("shirt_sure", F.lit(False))).alias("shirt_sure"), agreed(sure("team")).alias("sure_team"), agreed(sure("role")).alias("sure_role"),
        F.max(F.coalesce("confirmed", F.lit(False))).alias("confirmed"), F.max(F.coalesce("excluded", F.lit(False))).alias("excluded"), F.sum("n").alias("n"), dims.alias("dims"),
        F.min_by(F.struct("id", "sx", "sz", "su"), F.struct("s", "id")).alias("first"), F.max_by(F.struct("id", "ex", "ez", "eu"), F.struct("e", "id")).alias("last"),
        many(sure("team")).alias("c_team"), many(sure("role")).alias("c_role"), many("external").alias("c_external"), many("shirt").alias("c_shirt"),
    )
    conflict = lambda c, name: F.when(c, F.lit(name))
    conflicts = F.array_compact(F.array(conflict(F.col("c_team"), "team"), conflict(F.col("c_role"), "role"), conflict(F.col("c_external"), "external"), conflict(F.col("c_shirt"), "shirt"), conflict(F.size("dims") > 1, "dimension")))
    agree = F.size("dims") == 1
    weighted = F.transform(F.filter("members", lambda m: m["mean"].isNotNull()), lambda m: F.struct(F.greatest(F.lit(1), F.least(F.lit(20), m["n"])).cast("double").alias("w"), m["mean"].alias("v")))
    out = out.withColumns({"conflicts": conflicts, "mean": F.when(agree & (F.size(weighted) > 0), _mean(weighted)), "samples": F.when(agree, F.flatten(F.transform("members", lambda m: m["samples"]))).otherwise(F.array().cast("array<array<double>>"))})
    links = F.transform(F.slice("members", 2, 2**30), lambda m, i: F.struct(F.get("members", i)["id"].alias("pred"), m["id"].alias("succ"), F.round(m["s"] - F.get("members", i)["e"], 6).alias("gap")))
    return out.withColumn("links", links).withColumn("members", F.transform("members", lambda m: m["id"])).drop("c_team", "c_role", "c_external", "c_shirt")


def _median(values: Column) -> Column:
    """Of an array in order."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def candidate_edges(found: DataFrame, apart: DataFrame, config: ResolverConfig = ResolverConfig()) -> DataFrame:
    """Scored edges between the nodes of a scene that follow each other: scene, a, b (nodes), pred, succ
    (their tracklets that meet), state, score, source, reasons, gap.

    Pairs that overlap in time, contradict each other or could not have run the way are never made into
    rows, nor pairs without any evidence. An edge that only a human decision (``apart``: scene, a, b of
    tracklets) stands against is a row, rejected.
    """
    free = found.where(~F.col("excluded") & (F.size("conflicts") == 0))
    firm = F.col("shirt").isNotNull() & (F.col("shirt_sure") | ((F.col("shirt_conf") >= config.shirt_confidence) & (F.col("shirt_n") >= config.shirt_samples)))
    free = free.withColumn("firm_shirt", F.when(firm, F.col("shirt"))).withColumn("dim", F.get("dims", F.lit(0)))
    names = ["node", "members", "s", "e", "manual", "team", "role", "external", "shirt", "shirt_conf", "firm_shirt", "sure_team", "sure_role", "mean", "samples", "dim", "first", "last"]
    a, b = (free.select("scene", *(F.col(c).alias(f"{k}_{c}") for c in names)) for k in "ab")
    col = F.col
    differ = lambda c: F.coalesce(col(f"a_{c}") != col(f"b_{c}"), F.lit(False))
    same = lambda c: F.coalesce(col(f"a_{c}") == col(f"b_{c}"), F.lit(False))
    gap = col("b_s") - col("a_e")
    way = hypot(col("b_first.sx") - col("a_last.ex"), col("b_first.sz") - col("a_last.ez"))
    reach = config.speed * gap + config.slack + F.coalesce("a_last.eu", F.lit(0.0)) + F.coalesce("b_first.su", F.lit(0.0))
    hard = differ("manual") | differ("sure_team") | differ("sure_role") | differ("external") | differ("firm_shirt") | F.coalesce(way > reach, F.lit(False))
    pairs = a.join(b, "scene").where((col("a_e") + config.epsilon < col("b_s")) & ~hard)
    # Distances of all samples to each other, and of each to the nearest of the other side.
    comparable = same("dim")
    matrix = F.when(comparable, F.transform("a_samples", lambda x: F.transform(col("b_samples"), lambda y: cosine_distance(x, y))))
    there = (F.size("a_samples") > 0) & (F.size("b_samples") > 0)
    pairs = pairs.withColumns({"gap": gap, "way": way, "reach": reach, "mean_far": F.when(comparable, cosine_distance("a_mean", "b_mean")), "matrix": F.when(there, matrix)})
    left = F.sort_array(F.transform("matrix", lambda row: F.array_min(row)))
    right = F.sort_array(F.transform(F.sequence(F.lit(0), F.size("b_samples") - 1), lambda j: F.array_min(F.transform(col("matrix"), lambda row: F.get(row, j)))))
    pairs = pairs.withColumns({"left": F.when(col("matrix").isNotNull(), left), "right": F.when(col("matrix").isNotNull(), right)}).drop("matrix")
    support = lambda c: F.size(F.filter(c, lambda d: d <= config.strong_sample_distance))
    pairs = pairs.withColumns({"best": F.get("left", F.lit(0)), "robust": F.greatest(_median(col("left")), _median(col("right"))), "support": F.least(support("left"), support("right"))})
    external, shirt = same("external"), same("firm_shirt")
    weak_shirt = same("shirt") & ~shirt
    strong = F.coalesce((col("support") >= config.strong_samples) & (col("robust") <= config.strong_sample_distance) & (col("mean_far").isNull() | (col("mean_far") <= config.review_distance)), F.lit(False))
    review = ~strong & (F.coalesce(col("mean_far") <= config.review_distance, F.lit(False)) | F.coalesce(col("best") <= config.strong_distance, F.lit(False)))
    shirt_score = 0.94 + F.least(F.lit(0.035), F.greatest(F.lit(0.0), F.least("a_shirt_conf", "b_shirt_conf") - 0.8) * 0.175)
    told = lambda when, name, value: F.when(when, F.struct(F.lit(name).alias("name"), value.alias("value")))
    signals = F.array_compact(
        F.array(
            told(external, "external", F.lit(0.995)), told(shirt, "shirt", shirt_score), told(strong, "appearance", 1 - F.greatest("mean_far", "robust")),
            told(review, "appearance-to-review", 1 - F.least("mean_far", "best")), told(weak_shirt, "shirt-to-review", F.lit(0.65)),
        )
    )
    soft = F.array_compact(F.array(F.when(differ("team"), "team-differs"), F.when(differ("role"), "role-differs")))
    pairs = pairs.withColumns({"signals": signals, "soft": soft, "strong_n": external.cast("int") + shirt.cast("int") + strong.cast("int"), "is_external": external}).where(F.size("signals") > 0)
    score = F.array_max(F.transform("signals", lambda s: s["value"])) + F.least(F.lit(0.04), 0.02 * F.greatest(F.col("strong_n") - 1, F.lit(0)))
    score = score + F.coalesce(0.015 * F.greatest(F.lit(0.0), 1 - col("way") / F.greatest(F.lit(1e-6), col("reach"))), F.lit(0.0)) - 0.08 * F.size("soft")
    pairs = pairs.withColumn("score", F.bround(clamp(score, 0.0, 1.0), 6))
    taken = (col("strong_n") > 0) & (col("score") >= config.accept) & ((F.size("soft") == 0) | col("is_external"))
    edges = pairs.select(
        "scene", col("a_node").alias("a"), col("b_node").alias("b"), col("a_last.id").alias("pred"), col("b_first.id").alias("succ"), F.when(taken, "accepted").otherwise("review").alias("state"), "score",
        F.lit("automatic").alias("source"), F.concat(F.transform("signals", lambda s: s["name"]), F.col("soft")).alias("reasons"), F.round("gap", 6).alias("gap"),
    )
    told_apart = _apart_nodes(found, apart).select("scene", "a", "b", F.lit(True).alias("told_apart"))
    edges = edges.join(told_apart, ["scene", "a", "b"], "left")
    no = F.coalesce("told_apart", F.lit(False))
    return edges.withColumns({"state": F.when(no, "rejected").otherwise(F.col("state")), "source": F.when(no, "human").otherwise(F.col("source")), "reasons": F.when(no, F.array(F.lit("told-apart"))).otherwise(F.col("reasons"))}).drop("told_apart")


def _apart_nodes(found: DataFrame, apart: DataFrame) -> DataFrame:
    """Human decisions as pairs of nodes, in both directions; a decision about unknown tracklets says nothing."""
    of = found.select("scene", "node", F.explode("members").alias("id"))
    both = apart.select("scene", "a", "b").unionByName(apart.select("scene", F.col("b").alias("a"), F.col("a").alias("b")))
    named = both.join(of.select("scene", F.col("id").alias("a"), F.col("node").alias("na")), ["scene", "a"]).join(of.select("scene", F.col("id").alias("b"), F.col("node").alias("nb")), ["scene", "b"])
    return named.select("scene", F.col("na").alias("a"), F.col("nb").alias("b")).distinct()


def demote_competing(edges: DataFrame, config: ResolverConfig = ResolverConfig()) -> DataFrame:
    """Accepted edges go to review where another edge of the same node, at either end, is within the margin
    of the node's best; a score counts less the longer the gap. Rejected edges compete with nothing."""
    rank = F.col("score") - F.least(F.lit(config.gap_penalty_most), F.greatest(F.lit(0.0), F.col("gap")) * config.gap_penalty)
    out = edges.withColumn("rank", F.when(F.col("state") != "rejected", rank))
    reasons = []
    for side, name in (("b", "competing-predecessors"), ("a", "competing-successors")):
        w = Window.partitionBy("scene", side)
        out = out.withColumn("near", F.max("rank").over(w) - F.col("rank") < config.margin).withColumn(f"of_{side}", F.col("near") & (F.sum(F.col("near").cast("int")).over(w) > 1))
        reasons.append(F.when(F.col(f"of_{side}"), F.lit(name)))
    why = F.array_compact(F.array(*reasons))
    demoted = (F.col("state") == "accepted") & (F.size(why) > 0)
    return out.withColumns({"reasons": F.when(demoted, F.concat("reasons", why)).otherwise(F.col("reasons")), "state": F.when(demoted, "review").otherwise(F.col("state"))}).drop("rank", "near", "of_a", "of_b")


def one_successor(edges: DataFrame, config: ResolverConfig = ResolverConfig()) -> DataFrame:
    """Of the accepted edges, those of the largest total score with at most one predecessor and one successor
    of a node; no link costs what the acceptance limit does. The others go to review.

    Edges whose ends have no other accepted edge are settled in place. The rest falls into independent
    problems, the connected parts of the graph of contested ends, each solved by itself.
    """
    # What a node is as a predecessor and what it is as a successor are two ends.
    taken = F.col("state") == "accepted"
    n = lambda side: F.sum(taken.cast("int")).over(Window.partitionBy("scene", side))
    counted = cut(edges.withColumns({"n_a": n("a"), "n_b": n("b")}))
    contested = counted.where(taken & ((F.col("n_a") > 1) | (F.col("n_b") > 1)))
    end = lambda side: F.concat_ws("\x1f", F.lit(side), F.col("scene").cast("string"), F.col(side))
    ends = contested.withColumns({"end_a": end("a"), "end_b": end("b")})
    problem = components(ends, "end_a", "end_b").select(F.col("node").alias("end_a"), F.col("component").alias("problem"))
    kind = edges.schema["scene"].dataType.simpleString()

    def solve(rows: Rows) -> list[tuple]:
        left, right = sorted({r["a"] for r in rows}), sorted({r["b"] for r in rows})
        at = {v: i for i, v in enumerate(left)}, {v: i for i, v in enumerate(right)}
        cost = [[1e6] * (len(right) + len(left)) for _ in left]
        for r in rows:
            cost[at[0][r["a"]]][at[1][r["b"]]] = 1 - r["score"] + 1e-12 * (at[0][r["a"]] * len(right) + at[1][r["b"]])
        for i in range(len(left)):
            cost[i][len(right) + i] = 1 - config.accept + 1e-6 + 1e-12 * i
        chosen = {(i, j) for i, j in hungarian(cost)}
        return [(r["scene"], r["a"], r["b"], (at[0][r["a"]], at[1][r["b"]]) in chosen) for r in rows]

    solved = each_group(ends.join(problem, "end_a").select("problem", "scene", "a", "b", "score"), ["problem"], ["a", "b"], solve, f"scene {kind}, a string, b string, chosen boolean")
    out = counted.join(solved, ["scene", "a", "b"], "left")
    lost = (F.col("state") == "accepted") & ~F.coalesce("chosen", F.lit(True))
    return out.withColumns({"reasons": F.when(lost, F.concat("reasons", F.array(F.lit("another-link-chosen")))).otherwise(F.col("reasons")), "state": F.when(lost, "review").otherwise(F.col("state"))}).drop("n_a", "n_b", "chosen")


def grow_groups(found: DataFrame, edges: DataFrame, apart: DataFrame, config: ResolverConfig = ResolverConfig()) -> DataFrame:
    """What becomes of the accepted edges and the nodes: rows (scene, a, b, conflicts) of the edges and
    (scene, node, group) of the nodes, in one table with a column ``kind``.

    Edges join groups by falling score, then tracklets; an edge that would give a group two manual
    identities, external players, reliable shirts, sure teams or roles, vector lengths, or two tracklets
    told apart, joins nothing. The order matters only inside a connected part of the accepted edges.
    """
    taken = edges.where(F.col("state") == "accepted")
    name = lambda c: F.concat_ws("\x1f", F.col("scene").cast("string"), F.col(c))
    part = components(taken.withColumns({"na": name("a"), "nb": name("b")}), "na", "nb").select(F.col("node").alias("name"), F.col("component").alias("part"))
    kind = edges.schema["scene"].dataType.simpleString()
    evidence = F.struct("manual", "external", "shirt", "shirt_conf", "shirt_n", "shirt_sure", "sure_team", "sure_role", "dims")
    as_node = found.withColumn("name", name("node")).join(part, "name").select("part", "scene", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("pred"), F.lit(None).cast("string").alias("succ"), evidence.alias("of"))
    as_edge = taken.withColumn("name", name("a")).join(part, "name").select("part", "scene", F.lit(1).alias("kind"), "a", "b", "score", "pred", "succ", F.lit(None).cast(as_node.schema["of"].dataType).alias("of"))
    as_apart = _apart_nodes(found, apart).withColumn("name", name("a")).join(part, "name").select("part", "scene", F.lit(2).alias("kind"), "a", "b", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("pred"), F.lit(None).cast("string").alias("succ"), F.lit(None).cast(as_node.schema["of"].dataType).alias("of"))

    def fold(rows: Rows) -> list[tuple]:
        of = {r["a"]: [r["of"]] for r in rows if r["kind"] == 0}
        held = {node: {node} for node in of}
        no = {(r["a"], r["b"]) for r in rows if r["kind"] == 2}
        at = {node: node for node in of}
        out = []
        for r in (r for r in rows if r["kind"] == 1):
            p, q = at[r["a"]], at[r["b"]]
            if p == q:
                continue
            why = contradictions(of[p] + of[q], config)
            if any((x, y) in no for x in held[p] for y in held[q]):
                why.append("group-told-apart")
            if why:
                out.append(("edge", r["scene"], r["a"], r["b"], why))
                continue
            p, q = min(p, q), max(p, q)
            of[p] += of.pop(q)
            held[p] |= held.pop(q)
            at |= dict.fromkeys(held[p], p)
        return out + [("node", rows[0]["scene"], node, group, None) for node, group in at.items()]

    every = as_node.unionByName(as_edge).unionByName(as_apart)
    return each_group(every, ["part"], ["kind", F.desc("score"), "pred", "succ"], fold, f"kind string, scene {kind}, a string, b string, conflicts array<string>")


def contradictions(evidence: Rows, config: ResolverConfig) -> list[str]:
    """What speaks against these nodes being one person."""
    out = [f"group-{c.replace('_', '-')}" for c in ("manual", "external", "sure_team", "sure_role") if len({e[c] for e in evidence if e[c] is not None}) > 1]
    shirts: dict[str, list[dict]] = {}
    for e in evidence:
        if e["shirt"] is not None:
            shirts.setdefault(e["shirt"], []).append(e)
    firm = [s for s, of in shirts.items() if any(e["shirt_sure"] for e in of) or (max(e["shirt_conf"] for e in of) >= config.shirt_confidence and sum(e["shirt_n"] for e in of) >= config.shirt_samples)]
    if len(firm) > 1:
        out.append("group-shirt")
    if len({d for e in evidence for d in e["dims"]}) > 1:
        out.append("group-dimension")
    return out


def resolve(tracklets: DataFrame, apart: DataFrame | None = None, config: ResolverConfig = ResolverConfig()) -> Resolution:
    """Identities of all scenes' tracklets.

    ``tracklets``: scene, id (string, unique in a scene), s, e (seconds), n (observations), manual (must-link
    name), team, role, external, shirt, shirt_conf, shirt_n, mean and samples (vectors), sx, sz, su, ex, ez,
    eu (place and uncertainty at start and end), and the flags shirt_sure, team_sure, role_sure, confirmed,
    excluded. All but scene, id, s and e may be null. ``apart``: scene, a, b. The pairs of a scene are
    compared with each other, so a scene is a bounded stretch of a recording; large ones are split by
    the join. An empty table gives empty results; repeated ids in a scene are an error of the input.
    """
    spark = tracklets.sparkSession
    if apart is None:
        apart = spark.createDataFrame([], f"scene {tracklets.schema['scene'].dataType.simpleString()}, a string, b string")
    found = cut(nodes(tracklets))
    edges = cut(one_successor(demote_competing(candidate_edges(found, apart, config), config), config))
    grown = cut(grow_groups(found, edges, apart, config))
    vetoed = grown.where("kind = 'edge'").select("scene", "a", "b", "conflicts")
    edges = edges.join(vetoed, ["scene", "a", "b"], "left")
    no = F.col("conflicts").isNotNull()
    edges = edges.select("scene", "pred", "succ", F.when(no, "review").otherwise(F.col("state")).alias("state"), "score", "source", F.when(no, F.concat("reasons", "conflicts")).otherwise(F.col("reasons")).alias("reasons"), "gap", "a")
    linked = found.select("scene", F.inline("links"), "conflicts").select("scene", "pred", "succ", F.lit("accepted").alias("state"), F.lit(1.0).alias("score"), F.lit("must-link").alias("source"), "conflicts", "gap")
    of = grown.where("kind = 'node'").select("scene", F.col("a").alias("node"), F.col("b").alias("group"))
    grouped = found.join(of, ["scene", "node"], "left").withColumn("group", F.coalesce("group", "node"))
    lowest = edges.where("state = 'accepted'").groupBy("scene", F.col("a").alias("node")).agg(F.min("score").alias("lowest"))
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    identities = grouped.join(lowest, ["scene", "node"], "left").groupBy("scene", "group").agg(
        F.sort_array(F.flatten(F.collect_list("members"))).alias("tracklets"), F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n"), one("manual"), one("external"), one("team"), one("role"), one("shirt"),
        F.max("excluded").alias("excluded"), F.max("confirmed").alias("confirmed"), F.min("lowest").alias("lowest"),
    )
    as_ = lambda status, source, confidence: F.struct(F.lit(status).alias("status"), F.lit(source).alias("source"), confidence.alias("confidence"))
    said = (
        F.when(F.col("excluded"), as_("excluded", "human-excluded", F.lit(1.0)))
        .when(F.col("confirmed"), as_("resolved", "human", F.lit(1.0)))
        .when(F.col("external").isNotNull(), as_("resolved", "external", F.lit(0.99)))
        .when(F.col("lowest").isNotNull(), as_("resolved", "linked", F.col("lowest")))
        .otherwise(as_("provisional", "tracklet", F.lit(0.0)))
    )
    identity = F.when(F.col("manual").isNotNull(), F.concat(F.lit("manual:"), "manual")).when(F.col("external").isNotNull(), F.concat(F.lit("external:"), "external")).otherwise(F.get("tracklets", F.lit(0)))
    identities = cut(identities.withColumn("said", said).select("scene", identity.alias("identity"), "tracklets", "s", "e", "n", "manual", "external", "team", "role", "shirt", "said.*"))
    members = identities.select("scene", F.explode("tracklets").alias("id"), "identity")
    return Resolution(members, identities, edges.drop("a").unionByName(linked.withColumnRenamed("conflicts", "reasons")))
