"""Operators over ordered series: one pass of window functions over (track, time).

Rows are (event_id, track_id, t, x, z, conf, observed, kind). Every order is total: ties in time
are broken by event_id. Each operator shuffles once, by track.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numeric import hypot, lower_is_better


def track() -> WindowSpec:
    return Window.partitionBy("track_id").orderBy("t", "event_id")


def so_far() -> WindowSpec:
    return track().rowsBetween(Window.unboundedPreceding, 0)


def valid(points: DataFrame) -> DataFrame:
    """Observed points with a place and some confidence."""
    ok = F.col("observed") & (F.col("conf") != 0)
    for c in ("t", "x", "z"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return points.where(ok)


def adjacent_speed(points: DataFrame) -> DataFrame:
    """Speed to each point from the one before in its track; edges shorter than 1e-6 are left out."""
    dt = F.col("t") - F.lag("t").over(track())
    dist = hypot(F.col("x") - F.lag("x").over(track()), F.col("z") - F.lag("z").over(track()))
    edges = valid(points).withColumns({"dt": dt, "dist": dist})
    return edges.where(F.col("dt") > 1e-6).select("event_id", "track_id", "t", (F.col("dist") / F.col("dt")).alias("speed"))


def accelerations(points: DataFrame) -> DataFrame:
    """Change of velocity over consecutive triples."""
    lag = lambda c, k: F.lag(c, k).over(track())
    d1, d2 = F.col("t") - lag("t", 1), lag("t", 1) - lag("t", 2)
    rows = valid(points).withColumns({"d1": d1, "d2": d2, "x1": lag("x", 1), "x2": lag("x", 2), "z1": lag("z", 1), "z2": lag("z", 2)})
    rows = rows.where((F.col("d1") > 1e-6) & (F.col("d2") > 1e-6))
    ax = (F.col("x") - F.col("x1")) / F.col("d1") - (F.col("x1") - F.col("x2")) / F.col("d2")
    az = (F.col("z") - F.col("z1")) / F.col("d1") - (F.col("z1") - F.col("z2")) / F.col("d2")
    return rows.select("event_id", "track_id", (hypot(ax, az) / ((F.col("d1") + F.col("d2")) / 2)).alias("acceleration"))


@dataclass(frozen=True)
class MotionConfig:
    limit: float = 100.0
    good: float = 0.02
    fair: float = 0.05


def motion_quality(points: DataFrame, config: MotionConfig = MotionConfig()) -> DataFrame:
    """Per track: edges, share over the limit, p95 and largest speed, verdict."""
    out = adjacent_speed(points).groupBy("track_id").agg(
        F.count("*").alias("n_edges"), F.avg((F.col("speed") > config.limit).cast("double")).alias("ratio"), F.percentile("speed", F.lit(0.95)).alias("p95"), F.max("speed").alias("top")
    )
    return out.withColumn("verdict", lower_is_better(F.col("ratio"), config.good, config.fair))


def cadences(points: DataFrame) -> DataFrame:
    """Per track: median positive step of its distinct times, and p25 of its steps up to ``1``."""
    times = points.select("track_id", "t").distinct()
    d = F.col("t") - F.lag("t").over(Window.partitionBy("track_id").orderBy("t"))
    steps = times.withColumn("d", d).where(F.col("d") > 0)
    return steps.groupBy("track_id").agg(F.median("d").alias("cadence"), F.percentile(F.when((F.col("d") > 1e-6) & (F.col("d") <= 1), F.col("d")), F.lit(0.25)).alias("short_cadence"))


def continuity(points: DataFrame, least_gap: float = 0.6) -> DataFrame:
    """Per track: points, gaps over max(least_gap, 2.5 cadences), expected points and completeness."""
    rows = points.join(cadences(points), "track_id", "left").withColumn("d", F.col("t") - F.lag("t").over(track()))
    agg = rows.groupBy("track_id").agg(
        F.count("*").alias("n"), F.first("cadence").alias("cadence"), F.count_if(F.col("d") > F.greatest(F.lit(least_gap), 2.5 * F.col("cadence"))).alias("gaps"), (F.max("t") - F.min("t")).alias("span")
    )
    expected = F.greatest(F.lit(1), F.bround(F.try_divide("span", "cadence"), 0).cast("long") + 1)
    return agg.select("track_id", "n", "gaps", expected.alias("expected"), F.least(F.lit(1.0), F.col("n") / expected).alias("completeness"))


def islands(rows: DataFrame, flag: Column, by: str = "track_id", name: str = "island") -> DataFrame:
    """Number the runs of equal ``flag`` within a track."""
    w = Window.partitionBy(by).orderBy("t", "event_id")
    change = F.when(flag.eqNullSafe(F.lag(flag).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("change_", change).withColumn(name, F.sum("change_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("change_")


def longest_invalid_run(points: DataFrame) -> DataFrame:
    """Per track: longest run without observation, from first to last plus one cadence; 0 without one."""
    runs = islands(points.withColumn("ok", F.col("observed") & (F.col("conf") > 0)), F.col("ok")).groupBy("track_id", "island", "ok").agg((F.max("t") - F.min("t")).alias("span"))
    worst = runs.groupBy("track_id").agg(F.max(F.when(~F.col("ok"), F.col("span"))).alias("span"))
    return worst.join(cadences(points), "track_id", "left").select("track_id", F.when(F.col("span").isNull(), 0.0).otherwise(F.col("span") + F.coalesce("cadence", F.lit(0.0))).alias("longest"))


def edge_max_gap(points: DataFrame, start: float, end: float) -> DataFrame:
    """Per track: the longest time without a valid point, the ends of the scene included."""
    gaps = valid(points).withColumn("d", F.col("t") - F.lag("t").over(track()))
    return gaps.groupBy("track_id").agg(F.greatest(F.coalesce(F.max("d"), F.lit(0.0)), F.min("t") - start, F.lit(end) - F.max("t")).alias("max_gap"))


def smooth_121(points: DataFrame) -> DataFrame:
    """[1, 2, 1] / 4 over neighbours; first and last points stay."""
    out = {}
    for c in ("x", "z"):
        a, b = F.lag(c).over(track()), F.lead(c).over(track())
        out[f"s{c}"] = F.when(a.isNull() | b.isNull(), F.col(c)).otherwise((a + 2 * F.col(c) + b) / 4)
    return points.select("event_id", "track_id", *[v.alias(k) for k, v in out.items()])


@dataclass(frozen=True)
class SpliceConfig:
    allowance: float = 2.5
    soft: float = 14.0
    hard: float = 25.0


def splice_chains(points: DataFrame, config: SpliceConfig = SpliceConfig()) -> DataFrame:
    """Per track: the chain that is kept (most points, the first on a tie), its fragments and start.

    Distance beyond the mean uncertainty (1 - conf, at most the allowance) over the step: over
    ``soft`` a new fragment begins, over ``hard`` a new chain too.
    """
    u = 1 - F.col("conf")
    allowed = F.least(F.lit(config.allowance), (u + F.lag(u).over(track())) / 2)
    dist = hypot(F.col("x") - F.lag("x").over(track()), F.col("z") - F.lag("z").over(track()))
    speed = F.greatest(F.lit(0.0), dist - allowed) / F.greatest(F.lit(0.001), F.col("t") - F.lag("t").over(track()))
    rows = valid(points).withColumn("speed", F.when(F.lag("t").over(track()).isNotNull(), speed).otherwise(0.0))
    rows = rows.withColumn("chain", F.sum((F.col("speed") > config.hard).cast("int")).over(so_far())).withColumn("soft", (F.col("speed") > config.soft).cast("int"))
    chains = rows.groupBy("track_id", "chain").agg(F.count("*").alias("n"), F.min("t").alias("start"), F.sum("soft").alias("breaks"))
    best = Window.partitionBy("track_id").orderBy(F.desc("n"), "chain")
    return chains.withColumn("k", F.row_number().over(best)).where("k = 1").select("track_id", "chain", "n", "start", "breaks")


@dataclass(frozen=True)
class FillConfig:
    least_step: float = 0.25
    most_step: float = 0.75
    least_gap: float = 0.6
    default_cadence: float = 0.2
    confidence: float = 0.18
    most_uncertainty: float = 18.0


def gap_fill(points: DataFrame, config: FillConfig = FillConfig()) -> DataFrame:
    """Points put linearly into gaps between neighbours; never before the first or after the last."""
    steps = cadences(points).withColumn("c", F.coalesce("cadence", F.lit(config.default_cadence)))
    steps = steps.select("track_id", F.least(F.lit(config.most_step), F.greatest(F.lit(config.least_step), 2 * F.col("c"))).alias("step"), F.greatest(F.lit(config.least_gap), 2.5 * F.col("c")).alias("gap"))
    lead = lambda c: F.lead(c).over(track())
    rows = points.withColumns({"t2": lead("t"), "x2": lead("x"), "z2": lead("z"), "conf2": lead("conf")}).join(steps, "track_id")
    rows = rows.withColumn("d", F.col("t2") - F.col("t")).where(F.col("d") > F.col("gap"))
    rows = rows.withColumn("n", F.ceil((F.col("d") - 1e-6) / F.col("step")).cast("int") - 1).where("n > 0")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    share = F.col("k") * F.col("step") / F.col("d")
    u = F.least(F.lit(config.most_uncertainty), F.greatest(1 - F.col("conf"), 1 - F.col("conf2")) + 1 + 0.8 * F.col("d"))
    return rows.select("event_id", "track_id", "k", (F.col("t") + F.col("k") * F.col("step")).alias("t"), (F.col("x") + (F.col("x2") - F.col("x")) * share).alias("x"), (F.col("z") + (F.col("z2") - F.col("z")) * share).alias("z"), u.alias("uncertainty"))


def stable_run_switch(rows: DataFrame, least: int = 3) -> DataFrame:
    """Per sequence: runs of at least ``least`` equal predictions, and changes between neighbouring ones."""
    named = rows.where(F.col("pred").isNotNull())
    runs = islands(named, F.col("pred"), "seq").groupBy("seq", "island", "pred").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    after = F.lead("pred").over(Window.partitionBy("seq").orderBy("island"))
    runs = runs.withColumn("switch", (after != F.col("pred")).cast("int"))
    return runs.groupBy("seq").agg(F.count("*").alias("stable_runs"), F.coalesce(F.sum("switch"), F.lit(0)).alias("switches"))


def switches_and_fragments(rows: DataFrame) -> DataFrame:
    """Per ground truth: predictions other than the last known one; returns after a run without any."""
    w = Window.partitionBy("gt").orderBy("t", "event_id")
    known = F.last("pred", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    lost = F.lag("pred").over(w).isNull() & known.isNotNull()
    marked = rows.select("gt", "t", "event_id", (F.col("pred") != known).alias("switch"), (F.col("pred").isNotNull() & lost).alias("fragment"))
    return marked.groupBy("gt").agg(F.count_if("switch").alias("switches"), F.count_if("fragment").alias("fragments"))


def state_labels(points: DataFrame, longest: float = 12.0) -> DataFrame:
    """observed; inferred between observations at most ``longest`` apart; occluded else."""
    seen = F.when(F.col("observed"), F.col("t"))
    before = F.last(seen, ignorenulls=True).over(so_far())
    after = F.first(seen, ignorenulls=True).over(track().rowsBetween(0, Window.unboundedFollowing))
    state = F.when(F.col("observed"), "observed").when(after - before <= longest, "inferred").otherwise("occluded")
    return points.select("event_id", "track_id", state.alias("state"))


def gap_statistics(points: DataFrame) -> DataFrame:
    """Per track: runs of unobserved points, the longest and all of them in points."""
    runs = islands(points, F.col("observed")).where(~F.col("observed")).groupBy("track_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("track_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"), F.sum("n").alias("points"))


def interpolate_at(points: DataFrame, times: DataFrame) -> DataFrame:
    """Place of every track at each time of ``times`` (q), linear between points, held at the ends.

    ``times`` are merged into each track's series, so one window finds both neighbours.
    """
    asked = points.select("track_id").distinct().crossJoin(times.select("q"))  # a stated set of times
    both = points.select("track_id", "t", "x", "z", F.lit(None).cast("double").alias("q"), "event_id").unionByName(asked.select("track_id", F.col("q").alias("t"), "q"), allowMissingColumns=True)
    w = Window.partitionBy("track_id").orderBy("t", F.col("q").isNotNull(), "event_id")
    here = F.when(F.col("q").isNull(), F.struct("t", "x", "z"))
    a = F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumns({"a": a, "b": b}).where(F.col("q").isNotNull())

    def place(c: str) -> Column:
        share = F.try_divide(F.col("q") - F.col("a.t"), F.col("b.t") - F.col("a.t"))
        return F.when(F.col("a").isNull(), F.col(f"b.{c}")).when(F.col("b").isNull(), F.col(f"a.{c}")).otherwise(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * F.coalesce(share, F.lit(0.0)))

    return found.select("track_id", "q", place("x").alias("x"), place("z").alias("z"))


def path_segments(points: DataFrame, teleport: float = 60.0) -> DataFrame:
    """Runs of one evidence (observed or not), broken where the place jumps."""
    jump = hypot(F.col("x") - F.lag("x").over(track()), F.col("z") - F.lag("z").over(track())) > teleport
    change = F.when(F.lag("t").over(track()).isNull() | jump | (F.lag("observed").over(track()) != F.col("observed")), 1).otherwise(0)
    rows = points.withColumn("change", change).withColumn("segment", F.sum("change").over(so_far()))
    return rows.groupBy("track_id", "segment").agg(F.first("observed").alias("observed"), F.count("*").alias("n"), F.min("t").alias("t_start"), F.max("t").alias("t_end"))


def presence_summary(points: DataFrame) -> DataFrame:
    return points.groupBy("track_id").agg(F.count_if("observed").alias("n_observed"), F.count_if(~F.col("observed")).alias("n_hidden"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.min(F.when(F.col("observed"), F.col("t"))).alias("first_seen"), F.max(F.when(F.col("observed"), F.col("t"))).alias("last_seen"))


def overlay(automatic: DataFrame, manual: DataFrame, digits: int = 1) -> DataFrame:
    """One row per track and rounded time; a manual row wins, then the first by event_id."""

    def keyed(df: DataFrame, name: str) -> DataFrame:
        k = df.withColumn("rt", F.floor(F.col("t") * 10**digits + 0.5) / 10**digits)
        first = Window.partitionBy("track_id", "rt").orderBy("event_id")
        return k.withColumn("n_", F.row_number().over(first)).where("n_ = 1").select("track_id", "rt", F.col("x").alias(f"{name}_x"), F.col("event_id").alias(f"{name}_id"))

    both = keyed(automatic, "auto").join(keyed(manual, "manual"), ["track_id", "rt"], "full_outer")
    return both.select("track_id", "rt", F.coalesce("manual_x", "auto_x").alias("x"), F.when(F.col("manual_id").isNotNull(), "manual").otherwise("automatic").alias("origin"))


def clock_map(points: DataFrame, anchors: list[tuple[float, float]]) -> DataFrame:
    """Times mapped piecewise linearly through a few anchors, held outside them."""
    out = F.lit(anchors[-1][1])
    for (a, u), (b, v) in reversed(list(zip(anchors, anchors[1:]))):
        out = F.when(F.col("t") < b, F.lit(u) + (F.col("t") - a) * ((v - u) / (b - a))).otherwise(out)
    out = F.when(F.col("t") < anchors[0][0], F.lit(anchors[0][1])).otherwise(out)
    return points.select("event_id", out.alias("clock"))


def debounced(times: Column, least: float) -> Column:
    """Ordered times without those less than or equal ``least`` after the last one kept: a fold."""
    return F.aggregate(F.array_sort(times), F.array().cast("array<double>"), lambda kept, t: F.when((F.size(kept) == 0) | (t - F.try_element_at(kept, F.lit(-1)) > least), F.concat(kept, F.array(t))).otherwise(kept))


def cuts_to_segments(cuts: DataFrame, start: float, end: float, least_cut: float, least_segment: float) -> DataFrame:
    """Segments between debounced cuts (owner, t) that last at least ``least_segment``."""
    kept = cuts.groupBy("owner").agg(debounced(F.collect_list("t"), least_cut).alias("cuts"))
    edges = kept.withColumn("edges", F.concat(F.array(F.lit(start)), "cuts", F.array(F.lit(end))))
    pairs = edges.select("owner", F.posexplode(F.zip_with(F.slice("edges", 1, F.size("edges") - 1), F.slice("edges", 2, F.size("edges") - 1), lambda a, b: F.struct(a.alias("s"), b.alias("e")))))
    return pairs.select("owner", F.col("pos").alias("segment"), "col.s", "col.e").where(F.col("e") - F.col("s") >= least_segment)


def variant_letters(n: Column) -> Column:
    """1, 2, ... 26, 27: A, B, ... Z, AA."""
    i = n - 1
    return F.when(i < 26, F.chr(65 + i)).otherwise(F.concat(F.chr(65 + F.floor(i / 26) - 1), F.chr(65 + i % 26)))


def run_lengths(rows: DataFrame) -> DataFrame:
    """Run-length code of each sequence's predictions, nulls as runs of their own."""
    return islands(rows, F.col("pred"), "seq").groupBy("seq", "island").agg(F.first("pred").alias("pred"), F.count("*").alias("n"))
