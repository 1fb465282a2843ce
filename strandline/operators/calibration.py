"""Calibrations taken over from neighbours, agreed between both sides, and measured."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import determinant, inverse, multiply, project
from ..functions.numeric import let, smoothstep
from .solve import homography
from .temporal import PropagateConfig, disagreement


@dataclass(frozen=True)
class GridConfig:
    """Points of the lower image at which two calibrations are blended; fixed values."""

    columns: int = 6
    rows: int = 5
    left: float = 0.14
    right: float = 0.86
    top: float = 0.40
    bottom: float = 0.92
    least: int = 12
    farthest: float = 1e5


def scaled(m: Column) -> Column:
    """The matrix with a last entry of 1 (of norm 1 and a positive last entry where that is about 0); null if an
    entry is null or not finite, or if the matrix is about singular."""

    def of(m: Column) -> Column:
        good = (F.size(m) == 9) & F.forall(m, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.abs(determinant(m)) >= 1e-10)
        norm = F.sqrt(F.aggregate(m, F.lit(0.0), lambda s, x: s + x * x))
        last = F.element_at(m, 9)
        scale = F.when(F.abs(last) >= 1e-10, last).otherwise(norm * F.when(last < 0, -1.0).otherwise(1.0))
        return let(scale, lambda by: F.when(good & (F.abs(by) >= 1e-10), F.transform(m, lambda x: x / by)))

    return let(m, of)


def like(m: Column, other: Column) -> Column:
    """``m`` or -``m``, whichever points the way of ``other``: a homography has no sign."""
    dot = F.aggregate(F.zip_with(m, other, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.when(dot < 0, F.transform(m, lambda x: -x)).otherwise(m)


def consensus(found: DataFrame, frames: DataFrame, c: PropagateConfig = PropagateConfig(), grid: GridConfig = GridConfig()) -> DataFrame:
    """(scene, sample, earlier, later, weight, valid, h): one homography for frames that anchors on both sides agree on.

    ``found`` as of ``temporal.hypotheses``; ``frames``: scene, sample, t. The best hypothesis and the best one of
    the other direction are projected over a grid of the image, blended by a smooth weight that goes from the
    earlier anchor to the later one, and a homography is fitted to the blend. Frames without both directions,
    with sides that disagree by more than the rival distance, with fewer than ``grid.least`` points at finite
    places, or that no homography fits, have no row.
    """
    w = Window.partitionBy("scene", "sample", "forward").orderBy(F.desc("score"), "anchor")
    best = found.withColumn("k", F.row_number().over(w)).where("k = 1").join(frames.select("scene", "sample", "t"), ["scene", "sample"])
    # An anchor before the frame is ``forward``; its time follows from the distance.
    side = lambda forward, name: best.where(F.col("forward") == forward).select("scene", "sample", "t", F.col("anchor").alias(name), F.col("h").alias(f"h_{name}"), F.col("distance").alias(f"d_{name}"))
    both = side(True, "earlier").join(side(False, "later").drop("t"), ["scene", "sample"])
    both = both.where((F.col("d_earlier") + F.col("d_later") > 1e-9) & (disagreement(F.col("h_earlier"), F.col("h_later"), c) <= c.rival_distance))
    both = both.withColumn("weight", smoothstep(F.col("d_earlier") / (F.col("d_earlier") + F.col("d_later"))))
    step = lambda low, high, n: [low + (high - low) * i / (n - 1) for i in range(n)]
    points = F.array(*(F.struct(F.lit(c.width * x).alias("x"), F.lit(c.height * y).alias("y")) for y in step(grid.top, grid.bottom, grid.rows) for x in step(grid.left, grid.right, grid.columns)))
    pairs = F.transform(points, lambda p: F.struct(p.alias("image"), project(F.col("h_earlier"), p["x"], p["y"]).alias("a"), project(F.col("h_later"), p["x"], p["y"]).alias("b")))
    near = lambda q: q.isNotNull() & F.coalesce((F.abs(q["x"]) < grid.farthest) & (F.abs(q["y"]) < grid.farthest), F.lit(False))
    mixed = lambda s, k: s["a"][k] + (s["b"][k] - s["a"][k]) * F.col("weight")
    # The points of the image beside what they blend to, made once.
    sides = lambda p: F.struct(F.transform(p, lambda s: F.array(s["image"]["x"], s["image"]["y"])).alias("image"), F.transform(p, lambda s: F.array(mixed(s, "x"), mixed(s, "y"))).alias("pitch"))
    both = both.withColumn("fit", let(F.filter(pairs, lambda s: near(s["a"]) & near(s["b"])), lambda p: F.when(F.size(p) >= grid.least, sides(p)))).where(F.col("fit").isNotNull())
    found_h = both.select("scene", "sample", "earlier", "later", "weight", F.size("fit.image").alias("valid"), homography(F.col("fit.image"), F.col("fit.pitch")).alias("h"))
    return found_h.where(F.col("h").isNotNull())


def borrowed(evidence: DataFrame, source: str) -> DataFrame:
    """Calibrations of frames taken over from accepted neighbours: (scene, sample, reason, from_sample, to_sample, alpha, h).

    ``evidence``: scene, sample, t, accepted, h (image to pitch), camera (image to the stretch's reference image),
    motion (``estimated`` where the camera's motion since the sample before is known). ``source``: previous,
    next or interpolation; the row is of every frame that is not accepted. The neighbour's calibration is
    carried by the cameras' common reference, so no sample in between may start a new one. Interpolated
    matrices are brought to one scale and sign before they are mixed by time. ``reason``: borrowed, or why
    not: no-previous, no-next, camera-boundary, singular. ``h`` is scaled as by ``scaled``.
    """
    back = Window.partitionBy("scene").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("scene").orderBy("sample").rowsBetween(1, Window.unboundedFollowing)
    upto = Window.partitionBy("scene").orderBy("sample").rowsBetween(Window.unboundedPreceding, 0)
    # Breaks so far: none lie in (i, j] if the counts of i and j are equal.
    rows = evidence.withColumn("breaks", F.sum((~F.col("motion").eqNullSafe("estimated")).cast("int")).over(upto))
    good = F.coalesce("accepted", F.lit(False))
    stable = let(inverse(F.col("camera")), lambda back: scaled(multiply(F.col("h"), back)))
    rows = rows.withColumn("stable", F.when(good, stable))
    here = F.when(good, F.struct("sample", "t", "breaks", "stable"))
    rows = rows.withColumns({"a": F.last(here, ignorenulls=True).over(back), "b": F.first(here, ignorenulls=True).over(ahead)}).where(~good)
    a, b = F.col("a"), F.col("b")
    span = b["t"] - a["t"]
    alpha = F.when(span > 1e-9, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("t") - a["t"]) / span))).otherwise(0.5)
    if source == "previous":
        missing, crossed, carried, ends, alpha = F.when(a.isNull(), "no-previous"), a["breaks"] != F.col("breaks"), a["stable"], (a["sample"], F.lit(None)), F.lit(0.0)
    elif source == "next":
        missing, crossed, carried, ends, alpha = F.when(b.isNull(), "no-next"), b["breaks"] != F.col("breaks"), b["stable"], (F.lit(None), b["sample"]), F.lit(1.0)
    elif source == "interpolation":
        missing, crossed, ends = F.when(a.isNull(), "no-previous").when(b.isNull(), "no-next"), a["breaks"] != b["breaks"], (a["sample"], b["sample"])
        carried = scaled(F.zip_with(a["stable"], like(b["stable"], a["stable"]), lambda x, y: x + (y - x) * alpha))
    else:
        raise ValueError(f"unknown source {source}")
    rows = rows.withColumns({"alpha": alpha, "missing": missing, "crossed": crossed}).withColumn("made", let(carried, lambda m: scaled(multiply(m, F.col("camera")))))
    reason = F.coalesce("missing", F.when(F.col("crossed"), "camera-boundary").when(F.col("made").isNull(), "singular").otherwise("borrowed"))
    kind = evidence.schema["sample"].dataType
    fine = reason == "borrowed"
    return rows.select("scene", "sample", reason.alias("reason"), F.when(fine, ends[0]).cast(kind).alias("from_sample"), F.when(fine, ends[1]).cast(kind).alias("to_sample"), F.when(fine, F.col("alpha")).alias("alpha"), F.when(fine, F.col("made")).alias("h"))
