"""Operators with state of their own for each key, as Structured Streaming runs them.

State is a small tuple; each call gets one key's rows of one micro-batch and sorts them by time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _sorted(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["t", "event_id"], kind="stable")


def speeds(points: DataFrame, expiry: float = 0.65) -> DataFrame:
    """Speed from the point before, also across micro-batches; a track idle for longer than
    ``expiry`` starts anew; a time before the last one is an error.

    ``points``: (track_id bigint, event_id bigint, t double, x double, z double).
    """

    def step(key, frames, state: GroupState):
        last = state.get if state.exists else None
        out = []
        for r in _sorted(frames).itertuples():
            if last is not None:
                dt = r.t - last[0]
                if dt < 0:
                    raise ValueError(f"track {key[0]}: time {r.t} is before {last[0]}")
                if 1e-6 < dt <= expiry:
                    out.append((key[0], r.event_id, ((r.x - last[1]) ** 2 + (r.z - last[2]) ** 2) ** 0.5 / dt))
            last = (r.t, r.x, r.z)
        state.update(tuple(float(v) for v in last))
        yield pd.DataFrame(out, columns=["track_id", "event_id", "speed"])

    return points.groupBy("track_id").applyInPandasWithState(step, "track_id bigint, event_id bigint, speed double", "t double, x double, z double", "append", GroupStateTimeout.NoTimeout)


def coalesced_progress(ticks: DataFrame, interval: float = 1.0) -> DataFrame:
    """Progress ticks that are written: the first, a change of phase, completion, or ``interval``
    after the last one written. ``ticks``: (job bigint, event_id bigint, t double, phase string, done bigint, total bigint)."""

    def step(key, frames, state: GroupState):
        last = state.get if state.exists else None
        out = []
        for r in _sorted(frames).itertuples():
            if last is None or r.phase != last[1] or (r.total > 0 and r.done >= r.total) or r.t - last[0] >= interval:
                out.append((key[0], r.event_id, r.t, r.phase))
                last = (float(r.t), r.phase)
        state.update(last)
        yield pd.DataFrame(out, columns=["job", "event_id", "t", "phase"])

    return ticks.groupBy("job").applyInPandasWithState(step, "job bigint, event_id bigint, t double, phase string", "t double, phase string", "append", GroupStateTimeout.NoTimeout)


def separated(kept: list[tuple], gap: float, most: int) -> list[tuple]:
    """Of (bin, quality, event_id, t, fingerprint) by quality, then time, those ``gap`` from all taken, up to ``most``."""
    taken: list[tuple] = []
    for r in sorted(kept, key=lambda r: (-r[1], r[3], r[2])):
        if len(taken) < most and all(abs(r[3] - k[3]) >= gap for k in taken):
            taken.append(r)
    return taken


def reservoir(samples: DataFrame, late: str, idle: float = 5.0, width: float = 0.25, keep: int = 64, gap: float = 0.45, most: int = 12) -> DataFrame:
    """Per track the best samples far enough from each other, once the track has been idle.

    ``samples``: (track_id bigint, event_id bigint, ts timestamp, quality double, fingerprint string). A
    fingerprint counts once, its first sample. State holds the best sample of each time bin of ``width``
    seconds, of the ``keep`` best bins, and the fingerprints seen. A bin that was pushed out comes back only
    with a better sample, so the order in which micro-batches cut the rows does not matter. When the
    watermark (``late`` behind the newest row) is ``idle`` seconds past the track's last sample, the choice of
    up to ``most`` samples is emitted (track_id, event_id, t, quality) and the state goes. Samples without
    quality are nothing; those without a fingerprint are all different.
    """

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            bins, quality, ids, times, last, _ = state.get
            chosen = separated(list(zip(bins, quality, ids, times, times)), gap, most)
            state.remove()
            yield pd.DataFrame([(key[0], r[2], r[3], r[1]) for r in sorted(chosen, key=lambda r: r[3])], columns=["track_id", "event_id", "t", "quality"])
            return
        bins, quality, ids, times, last, seen = ([], [], [], [], 0.0, []) if not state.exists else state.get
        best = {b: (q, i, t) for b, q, i, t in zip(bins, quality, ids, times)}
        known = set(seen)
        for r in _sorted(frames).itertuples():
            last = max(last, r.t)
            if pd.isna(r.quality) or (r.fingerprint is not None and r.fingerprint in known):
                continue
            if r.fingerprint is not None:
                known.add(r.fingerprint)
            b = int(r.t // width)
            if b not in best or (r.quality, -r.event_id) > (best[b][0], -best[b][1]):
                best[b] = (float(r.quality), int(r.event_id), float(r.t))
        rows = sorted(best.items(), key=lambda kv: (-kv[1][0], kv[1][1]))[:keep]
        state.update(([b for b, _ in rows], [v[0] for _, v in rows], [v[1] for _, v in rows], [v[2] for _, v in rows], float(last), sorted(known)))
        state.setTimeoutTimestamp(max(int((last + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=["track_id", "event_id", "t", "quality"])

    timed = samples.withWatermark("ts", late).withColumn("t", F.unix_micros("ts") / 1e6)
    held = "bins array<bigint>, quality array<double>, ids array<bigint>, times array<double>, last double, seen array<string>"
    return timed.groupBy("track_id").applyInPandasWithState(step, "track_id bigint, event_id bigint, t double, quality double", held, "append", GroupStateTimeout.EventTimeTimeout)


def claims(requests: DataFrame, lease: float = 30.0, most: int = 3) -> DataFrame:
    """A queue of leased jobs: a claim is granted where no lease is live, up to ``most`` attempts.

    ``requests``: (job bigint, event_id bigint, t double, owner string, kind string: claim, beat, done).
    Gives a verdict for each: granted, held, dead, renewed, lost or finished.
    """

    def step(key, frames, state: GroupState):
        owner, ends, tries, over = state.get if state.exists else ("", -1.0, 0, False)
        out = []
        for r in _sorted(frames).itertuples():
            live = ends > r.t  # a lease that ends now is dead
            if over:
                verdict = "finished"
            elif r.kind == "claim":
                verdict = "held" if live else "dead" if tries >= most else "granted"
                if verdict == "granted":
                    owner, ends, tries = r.owner, r.t + lease, tries + 1
            elif live and r.owner == owner:
                verdict = "renewed" if r.kind == "beat" else "finished"
                ends, over = r.t + lease, r.kind == "done"
            else:
                verdict = "lost"
            out.append((key[0], r.event_id, verdict))
        state.update((owner, float(ends), int(tries), bool(over)))
        yield pd.DataFrame(out, columns=["job", "event_id", "verdict"])

    return requests.groupBy("job").applyInPandasWithState(step, "job bigint, event_id bigint, verdict string", "owner string, ends double, tries int, over boolean", "append", GroupStateTimeout.NoTimeout)
