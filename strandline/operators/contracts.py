"""What records must satisfy, jobs that wait for others, and timelines in short form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Kinds of a player's actions and of moments in them; fixed values.
ACTIONS = ["idle", "walk", "run", "sprint", "turn", "jump", "fall", "get-up", "first-touch", "drive", "pass", "cross", "shot", "header", "throw-in", "clearance", "tackle", "slide-tackle", "block", "interception", "feint"]
MOMENTS = ["wind-up", "contact", "release", "apex", "impact", "recovery"]


def fits(document: Column, most_bytes: int) -> Column:
    """Whether a document's JSON takes at most so many bytes; a null one does."""
    return F.coalesce(F.octet_length(F.to_json(document)) <= most_bytes, F.lit(True))


def action_problems(actions: DataFrame, people: DataFrame, actions_known: list[str] = ACTIONS, moments_known: list[str] = MOMENTS, most: int = 24) -> DataFrame:
    """(id, problems) of every action: all that is wrong with it, in order; empty: it may be stored.

    ``actions``: id, person, type, start, stop, keypoints (array of struct(kind, time)); ``people``: person, duration of
    the scene. Times are finite and not negative, a stop is after its start and within the scene, keypoints
    lie within the action, in rising order, at most ``most``. Two actions of one id are both wrong.
    """
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    twice = F.count("*").over(Window.partitionBy("id")) > 1
    rows = actions.withColumn("twice", twice).join(people.select("person", F.col("duration").alias("scene_end")), "person", "left")
    k = F.coalesce("keypoints", F.array().cast(actions.schema["keypoints"].dataType))
    times = F.transform(k, lambda p: p["time"])
    inside = F.forall(k, lambda p: yes(number(p["time"]) & (p["time"] >= F.col("start")) & (p["time"] <= F.col("stop"))))
    rising = times == F.array_sort(times)
    told = lambda wrong, name: F.when(wrong, name)
    problems = F.array_compact(
        F.array(
            told(~yes(F.col("id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,119}$")), "bad-id"), told(F.col("id").isNotNull() & F.col("twice"), "duplicate-id"), told(F.col("scene_end").isNull(), "unknown-person"), told(~yes(F.col("type").isin(actions_known)), "unknown-type"),
            told(~yes(number(F.col("start")) & (F.col("start") >= 0)), "bad-start"), told(~yes(number(F.col("stop")) & (F.col("stop") > F.col("start"))), "bad-stop"), told(yes(F.col("stop") > F.col("scene_end")), "after-scene"),
            told(F.size(k) > most, "too-many-keypoints"), told(~F.forall(k, lambda p: yes(p["kind"].isin(moments_known))), "unknown-keypoint"), told(~inside, "keypoint-outside"), told(inside & ~rising, "keypoints-unordered"),
        )
    )
    return rows.select("id", problems.alias("problems"))


def waiting_jobs(jobs: DataFrame, waits: DataFrame, now: float, yield_for: float) -> DataFrame:
    """Where jobs that wait for others stand: (job, state, open, failed, again).

    ``jobs``: job, status (queued, processing, ready, failed, cancelled); ``waits``: job, child, optional. ``ready`` once no
    child is open; ``failed`` as soon as a required child failed, was cancelled or is unknown; else ``waiting``, to be
    looked at again ``yield_for`` later. Children of one job are counted once; a job without children is ready.
    """
    child = jobs.select(F.col("job").alias("child"), F.col("status").alias("child_status"))
    w = waits.groupBy("job", "child").agg(F.min(F.coalesce("optional", F.lit(False)).cast("int")).alias("optional")).join(child, "child", "left")
    lost = ~F.coalesce(F.col("child_status").isin("queued", "processing", "ready"), F.lit(False))
    sums = w.groupBy("job").agg(F.count_if(F.col("child_status").isin("queued", "processing")).alias("open"), F.count_if(lost & (F.col("optional") == 0)).alias("failed"))
    rows = jobs.select("job").join(sums, "job", "left").fillna(0, ["open", "failed"])
    state = F.when(F.col("failed") > 0, "failed").when(F.col("open") > 0, "waiting").otherwise("ready")
    return rows.select("job", state.alias("state"), "open", "failed", F.when(state == "waiting", F.lit(now + yield_for)).alias("again"))


def manifest_problems(samples: DataFrame, people: DataFrame, points: DataFrame) -> DataFrame:
    """(sample, problem, detail) of a benchmark manifest, each once: duplicate or empty sample ids, frame rates that are
    not positive, people and calibration points without an id or twice in one frame, and boxes without area.

    ``samples``: sample, rate; ``people``: sample, frame, person, w, h; ``points``: sample, frame, point.
    """
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    s = samples.groupBy("sample").agg(F.count("*").alias("n"), F.min("rate").alias("rate"))
    nothing = F.lit("")
    found = [
        s.where(empty("sample")).select("sample", F.lit("sample-without-id").alias("problem"), nothing.alias("detail")), s.where(~empty("sample") & (F.col("n") > 1)).select("sample", F.lit("duplicate-sample"), nothing), s.where(F.col("rate") <= 0).select("sample", F.lit("bad-frame-rate"), nothing),
        people.where(~((F.col("w") > 0) & (F.col("h") > 0)) | F.col("w").isNull() | F.col("h").isNull()).select("sample", F.lit("bad-box"), F.concat_ws("/", F.col("frame").cast("string"), "person")),
    ]
    for rows, id_, name in ((people, "person", "person"), (points, "point", "point")):
        g = rows.groupBy("sample", "frame", id_).agg(F.count("*").alias("n"))
        found.append(g.where(empty(id_)).select("sample", F.lit(f"{name}-without-id"), F.col("frame").cast("string")))
        found.append(g.where(~empty(id_) & (F.col("n") > 1)).select("sample", F.lit(f"duplicate-{name}"), F.concat_ws("/", F.col("frame").cast("string"), id_)))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def compact_timeline(rows: DataFrame, key: str) -> DataFrame:
    """Runs of equal states as one row each: (key, state, first, last, n, frames), in the order of the frames.

    ``rows``: key, frame, state. A run goes on over frames that are not there; ``frames`` is null where the
    run holds every frame from first to last, else the frames that it has. Repeated rows count once.
    """
    w = Window.partitionBy(key).orderBy("frame", "state")
    laid = rows.select(key, "frame", "state").distinct()
    begins = ~F.col("state").eqNullSafe(F.lag("state").over(w)) | (F.row_number().over(w) == 1)
    runs = laid.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(key, "run").agg(F.first("state").alias("state"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"), F.sort_array(F.collect_list("frame")).alias("frames"))
    return out.select(key, "state", "first", "last", "n", F.when(F.col("n") < F.col("last") - F.col("first") + 1, F.col("frames")).alias("frames"))
