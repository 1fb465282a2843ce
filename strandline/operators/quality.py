"""Evaluation: distributions, gates, precision and recall, localisation, identity scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .assign import hungarian
from .checkpoint import cut
from .groups import each_group


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, median, p95, root mean square and largest value."""
    v = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.percentile(v, F.lit(0.95)).alias("p95"), F.sqrt(F.avg(v * v)).alias("rmse"), F.max(v).alias("top")
    )


def percentile_grid(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Exact percentiles by linear interpolation, one column each."""
    return rows.groupBy(*by).agg(*[F.percentile(value, F.lit(q)).alias(f"p{round(100 * q):02d}") for q in shares])


def precision_recall(rows: DataFrame) -> DataFrame:
    """Running precision and recall by falling score (then id), and the best precision from there on.

    ``rows``: (id, truth, score); those without a score are left out. The order is global: rows are dealt
    to ranges of (score, id) of about equal size, whatever the scores, and written with their range's
    number; running sums inside a range start from the totals of the ranges before it.
    """
    w = Window.partitionBy("part").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    scored = rows.select("id", "truth", "score").where(F.col("score").isNotNull())
    parts = cut(scored.repartitionByRange(F.desc("score"), "id").withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("part").agg(F.count("*").alias("n"), F.sum("truth").alias("p"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0"), F.sum("p").over(Window.partitionBy()).alias("positives"))
    run = parts.withColumns({"k": F.count("*").over(w), "tp": F.sum("truth").over(w)}).join(sums, "part")
    run = run.select("id", "truth", "part", "positives", (F.col("n0") + F.col("k")).alias("rank"), (F.col("p0") + F.col("tp")).alias("tp"))
    run = run.withColumns({"precision": F.col("tp") / F.col("rank"), "recall": F.try_divide("tp", "positives")})
    # Backwards, so that the maximum runs on: Spark counts a frame that only ends with the part anew for every row.
    after = Window.partitionBy("part").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    best = run.groupBy("part").agg(F.max("precision").alias("best"))
    later = best.select("part", F.max("best").over(Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    run = run.join(later, "part").withColumn("envelope", F.greatest(F.max("precision").over(after), F.coalesce("later", F.lit(0.0))))
    return run.select("id", "truth", "rank", "tp", "precision", "recall", "envelope", "positives")


def average_precision(rows: DataFrame) -> DataFrame:
    """Envelope precision summed at the true positives; null without positives."""
    return precision_recall(rows).agg(F.try_divide(F.sum(F.when(F.col("truth") == 1, F.col("envelope"))), F.max("positives")).alias("average_precision"), F.count("*").alias("n"))


def confusion(rows: DataFrame, truth: Column, guess: Column, kinds: list) -> DataFrame:
    """One row per truth with a column per guess."""
    counted = rows.select(truth.alias("truth"), guess.alias("guess"))
    return counted.groupBy("truth").agg(*[F.count_if(F.col("guess") == k).alias(f"as_{k}") for k in kinds], F.count("*").alias("n"))


def detection_scores(frames: DataFrame, matches: DataFrame) -> DataFrame:
    """Precision, recall and F1 from counts per frame and one-to-one matches."""
    tp = matches.agg(F.count("*").alias("tp"))
    sums = frames.agg(F.sum("n_gt").alias("gt"), F.sum("n_pred").alias("pred")).crossJoin(tp)
    p, r = F.try_divide("tp", "pred"), F.try_divide("tp", "gt")
    return sums.select("tp", (F.col("pred") - F.col("tp")).alias("fp"), (F.col("gt") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))


def localisation(rows: DataFrame, far: float) -> DataFrame:
    """``rows``: (frame, gx, gy, px, py), null where a side has none. A far prediction is a false
    positive and a miss at once."""
    d = F.sqrt((F.col("gx") - F.col("px")) * (F.col("gx") - F.col("px")) + (F.col("gy") - F.col("py")) * (F.col("gy") - F.col("py")))
    marked = rows.withColumn("d", d)
    hit = F.col("d") <= far
    return marked.agg(
        F.count_if(hit).alias("hits"), F.count_if(F.col("px").isNotNull() & ~F.coalesce(hit, F.lit(False))).alias("false_positives"), F.count_if(F.col("gx").isNotNull() & ~F.coalesce(hit, F.lit(False))).alias("misses"), F.avg(F.when(hit, F.col("d"))).alias("mean_error")
    )


def contingency(rows: DataFrame) -> DataFrame:
    """How often each ground truth went with each prediction; equal rows count once."""
    return rows.where(F.col("gt").isNotNull() & F.col("pred").isNotNull()).select("seq", "t", "gt", "pred").distinct().groupBy("seq", "gt", "pred").count()


def identity_f1(rows: DataFrame, by: str = "seq") -> DataFrame:
    """IDF1 per sequence: the one-to-one map of identities that explains most rows.

    ``rows``: (by, t, gt, pred). A time with two predictions for one truth makes the sequence invalid.
    """
    kept = rows.where(F.col("gt").isNotNull() | F.col("pred").isNotNull()).select(by, "t", F.col("gt").cast("string").alias("gt"), F.col("pred").cast("string").alias("pred")).distinct()
    bad = kept.where(F.col("gt").isNotNull()).groupBy(by, "t", "gt").agg(F.countDistinct("pred").alias("k")).where("k > 1").select(by).distinct().withColumn("invalid", F.lit(True))
    table = cut(kept.groupBy(by, "gt", "pred").count())
    kind = rows.schema[by].dataType.simpleString()
    both = table.where(F.col("gt").isNotNull() & F.col("pred").isNotNull())
    # With one truth or one prediction the best map is its most frequent pair; Python gets the others only.
    sides = both.groupBy(by).agg(F.countDistinct("gt").alias("n_gt"), F.countDistinct("pred").alias("n_pred"), F.max("count").alias("most"))
    trivial = sides.where((F.col("n_gt") == 1) | (F.col("n_pred") == 1)).select(by, F.col("most").alias("tp"))

    def solve(found: list[dict]) -> list[tuple]:
        left, right = sorted({r["gt"] for r in found}), sorted({r["pred"] for r in found})
        v = np.zeros((len(left), len(right)))
        for r in found:
            v[left.index(r["gt"]), right.index(r["pred"])] = r["count"]
        return [(found[0][by], int(sum(v[i, j] for i, j in hungarian(-v))))]

    solved = each_group(both.join(sides.where((F.col("n_gt") > 1) & (F.col("n_pred") > 1)).select(by), by, "left_semi"), [by], ["gt", "pred"], solve, f"{by} {kind}, tp bigint")
    sums = table.groupBy(by).agg(F.coalesce(F.sum(F.when(F.col("gt").isNotNull(), F.col("count"))), F.lit(0)).alias("n_gt"), F.coalesce(F.sum(F.when(F.col("pred").isNotNull(), F.col("count"))), F.lit(0)).alias("n_pred"))
    scores = sums.join(trivial.unionByName(solved), by, "left").withColumn("idtp", F.coalesce("tp", F.lit(0)).cast("long"))
    scores = scores.select(by, "idtp", (F.col("n_pred") - F.col("idtp")).alias("idfp"), (F.col("n_gt") - F.col("idtp")).alias("idfn"), F.try_divide(2.0 * F.col("idtp"), F.col("n_gt") + F.col("n_pred")).alias("idf1"))
    return scores.join(bad, by, "left").select(by, "idtp", "idfp", "idfn", F.when(F.col("invalid"), None).otherwise(F.col("idf1")).alias("idf1"), F.when(F.col("invalid"), "invalid").otherwise("valid").alias("status"))


def worst_verdict(verdicts: Column) -> Column:
    """Over required gates: any reject, else any review or unknown, else pass."""
    return F.when(F.array_contains(verdicts, "reject"), "reject").when(F.array_contains(verdicts, "review") | F.array_contains(verdicts, "unknown"), "review").otherwise("pass")


def gates(values: DataFrame, rules: list[tuple[str, str, bool, float, float]]) -> DataFrame:
    """One row per gate (name, column, higher is better, good, fair) with value and verdict."""
    from ..functions.numeric import higher_is_better, lower_is_better

    rows = [F.struct(F.lit(name).alias("gate"), F.col(column).cast("double").alias("value"), (higher_is_better if up else lower_is_better)(F.col(column), good, fair).alias("verdict")) for name, column, up, good, fair in rules]
    return values.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def number_reading(rows: DataFrame) -> DataFrame:
    """``rows``: (person, truth, number), truth null where nobody could read it, number null where
    nothing was recognised. Counts and rates of right, wrong and withheld readings, readings of the
    unreadable, and persons read as several numbers."""
    persons = rows.where(F.col("number").isNotNull()).groupBy("person").agg(F.countDistinct("number").alias("k")).agg(F.count_if(F.col("k") > 1).alias("conflicts"), F.count("*").alias("read_persons"))
    readable = F.col("truth").isNotNull()
    sums = rows.agg(
        F.count_if(readable).alias("readable"), F.count_if(readable & (F.col("number") == F.col("truth"))).alias("exact"), F.count_if(readable & (F.col("number") != F.col("truth"))).alias("substituted"),
        F.count_if(readable & F.col("number").isNull()).alias("abstained"), F.count_if(~readable & F.col("number").isNotNull()).alias("invented"),
    )
    both = sums.crossJoin(persons)  # one row each
    return both.select("*", F.try_divide("exact", "readable").alias("exact_rate"), F.try_divide("substituted", "readable").alias("substitution_rate"), F.try_divide("abstained", "readable").alias("abstention_rate"), F.try_divide("conflicts", "read_persons").alias("conflict_rate"))


def report(values: DataFrame, rules: list[tuple[str, str, bool, float, float]], required: list[str]) -> DataFrame:
    """All gates as one row: the overall verdict over the required ones, and each gate's verdict."""
    out = gates(values, rules)
    need = F.col("gate").isin(required)
    sums = out.agg(F.collect_list(F.when(need, F.col("verdict"))).alias("v"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("gate", "verdict")))).alias("gates"))
    return sums.select(worst_verdict(F.col("v")).alias("verdict"), F.to_json("gates").alias("gates"))


def pair_distances(vectors: DataFrame, block: int = 32_768) -> DataFrame:
    """(same, d, n): how many pairs of all unit vectors (id, person, v) have which cosine distance,
    at six decimals; ``same``: both are of one person.

    Vectors are dealt into blocks of about ``block``, or fewer so that all tasks have work; each pair of blocks is compared by
    tiles, and a task counts all its pairs of blocks in one table of distances. A vector is shuffled once per block.
    """
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    count = vectors.count()
    blocks = max(1, -(-count // block), min(int((2 * tasks) ** 0.5), -(-count // 500)))
    b, k = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    codes = F.when(F.col("person").isNotNull(), F.xxhash64("person"))
    dealt = vectors.select("id", codes.alias("person"), "v", b.alias("b"), k.alias("k")).withColumns({"low": F.least("b", "k"), "high": F.greatest("b", "k")}).drop("k")
    steps, tile = 2_000_001, 64
    out = to_arrow_schema(StructType.fromDDL("same boolean, d double, n bigint"))

    def add(cell: pa.Table, found: np.ndarray) -> None:
        own = cell["b"].to_numpy()
        low, high = cell["low"][0].as_py(), cell["high"][0].as_py()
        ids, v = cell["id"].to_numpy(), np.stack(cell["v"].to_numpy())
        person, known = cell["person"].fill_null(0).to_numpy(), cell["person"].is_valid().to_numpy()
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        columns, told = v[right].T.copy(), bool(known.all())
        person = np.unique(person, return_inverse=True)[1].astype(np.int32)
        for at in range(0, len(left), tile):
            rows = left[at : at + tile]
            d = v[rows] @ columns  # from here on in place: the table of pairs is the largest thing held
            np.clip(np.subtract(1.0, d, out=d), 0.0, 2.0, out=d)
            place = np.rint(np.multiply(d, 1e6, out=d), out=d).astype(np.int32)
            kind = (person[rows][:, None] == person[right][None]).astype(np.int32)
            if not told:
                kind[~(known[rows][:, None] & known[right][None])] = 2
            place += np.multiply(kind, np.int32(steps), out=kind)
            i, j = ids[rows][:, None], ids[right][None]
            use = (i < j) if low == high else (i != j)
            part = np.bincount(place.ravel() if use.all() else place[use])
            found[: len(part)] += part

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found = np.zeros(3 * steps, np.int64)
        for batch in batches:
            low, high = batch["low"].to_numpy(), batch["high"].to_numpy()
            ends = [0, *(np.flatnonzero((low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1), len(low)]
            for i, j in zip(ends, ends[1:]):
                if held and j > i and (held[0]["low"][0].as_py(), held[0]["high"][0].as_py()) != (low[i], high[i]):
                    add(pa.Table.from_batches(held), found)
                    held = []
                if j > i:
                    held.append(batch.slice(i, j - i))
        if held:
            add(pa.Table.from_batches(held), found)
        cells = np.flatnonzero(found)
        for at in range(0, len(cells), 100_000):
            c = cells[at : at + 100_000]
            kind = c // steps
            yield pa.RecordBatch.from_arrays([pa.array(kind == 1, pa.bool_(), mask=kind == 2), pa.array(c % steps / 1e6), pa.array(found[c])], schema=out)

    found = dealt.repartition(tasks, "low", "high").sortWithinPartitions("low", "high").mapInArrow(task, "same boolean, d double, n bigint")
    return found.groupBy("same", "d").agg(F.sum("n").alias("n"))


def greedy_truths(pairs: DataFrame, least: float) -> DataFrame:
    """(frame, p_id, g_id): predictions that find a truth, by falling score, then id.

    ``pairs``: frame, g_id, p_id, score, iou. Each prediction takes the truth of its frame that it overlaps
    most (the larger id on a tie) of those that are free, if by ``least``; else it finds none and takes none.
    Pairs that meet no other pair are settled in place; only frames with others are folded.
    """
    near = pairs.where(F.col("iou") >= least)
    alone = lambda side: F.count("*").over(Window.partitionBy("frame", side)) == 1
    near = near.withColumn("alone", alone("g_id") & alone("p_id"))
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("frame", "p_id", "g_id")}

    def fold(rows: list[dict]) -> list[tuple]:
        used, done, out = set(), set(), []
        for r in rows:  # of one prediction the best overlap first
            if r["p_id"] not in done and r["g_id"] not in used:
                used.add(r["g_id"])
                done.add(r["p_id"])
                out.append((r["frame"], r["p_id"], r["g_id"]))
        return out

    folded = each_group(near.where(~F.col("alone")), ["frame"], [F.desc("score"), "p_id", F.desc("iou"), F.desc("g_id")], fold, ", ".join(f"{c} {k}" for c, k in kinds.items()))
    return near.where("alone").select("frame", "p_id", "g_id").unionByName(folded)


def detection_average_precision(boxes: DataFrame, pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """Average precision of detections over all frames, and its counts: one row (average_precision, truths, predictions, found).

    ``boxes``: frame, id, score, side (gt or pred); ``pairs`` as for ``greedy_truths``. Recall counts all truths,
    also of frames without a prediction; null without truths, 0 without predictions.
    """
    hits = greedy_truths(pairs, least).select("frame", F.col("p_id").alias("id"), F.lit(1).alias("hit"))
    preds = boxes.where("side = 'pred'").select("frame", "id", "score").join(hits, ["frame", "id"], "left")
    key = F.struct("frame", "id")
    run = precision_recall(preds.select(key.alias("id"), F.coalesce("hit", F.lit(0)).alias("truth"), "score"))
    sums = run.agg(F.coalesce(F.sum(F.when(F.col("truth") == 1, F.col("envelope"))), F.lit(0.0)).alias("area"), F.count("*").alias("predictions"), F.coalesce(F.sum("truth"), F.lit(0)).alias("found"))
    truths = boxes.where("side = 'gt'").agg(F.count("*").alias("truths"))
    return sums.crossJoin(truths).select(F.try_divide("area", F.col("truths").cast("double")).alias("average_precision"), "truths", "predictions", "found")  # one row each
