"""Match events as evidence that an observed person is a player of the roster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EventConfig:
    # Fixed values of the roster score: seconds by which times of one event may differ, and by which an
    # event may lie outside of the person's and of the player's intervals.
    event_tolerance: float = 3.0
    seen_tolerance: float = 3.0
    active_tolerance: float = 2.0


def inside(t: Column, intervals: Column, tolerance: float) -> Column:
    """Whether a time is in one of the (s, e), both ends and the tolerance included; false without intervals."""
    return F.coalesce(F.exists(intervals, lambda i: (i["s"] - tolerance <= t) & (t <= i["e"] + tolerance)), F.lit(False))


def event_evidence(people: DataFrame, players: DataFrame, config: EventConfig = EventConfig()) -> DataFrame:
    """What the events that a person and a player share say: person, player, event_conf (the best of the
    events that fit, null if none does), event_conflicts, event_reasons (each once, in order).

    ``people``: person, source, event, kind, t, confidence, intervals (seen, array of (s, e)); ``players``: the
    same with player and its active intervals. The join is on source and event, so pairs without a common event
    are absent. Of repeated events of one person or player all count.
    """
    c, col = config, F.col
    a = people.select("source", "event", "person", *(col(k).alias(f"a_{k}") for k in ("kind", "t", "confidence", "intervals")))
    b = players.select("source", "event", "player", *(col(k).alias(f"b_{k}") for k in ("kind", "t", "confidence", "intervals")))
    state = (
        F.when(~col("a_kind").eqNullSafe(col("b_kind")), "event-kind-mismatch")
        .when(col("a_t").isNull() | col("b_t").isNull(), "event-time-unavailable")
        .when(F.abs(col("a_t") - col("b_t")) > c.event_tolerance, "event-time-mismatch")
        .when(~inside(col("a_t"), col("a_intervals"), c.seen_tolerance), "event-outside-canonical-visible-interval")
        .when(~inside(col("b_t"), col("b_intervals"), c.active_tolerance), "event-outside-player-active-interval")
    )
    conflict = state.isin("event-kind-mismatch", "event-time-mismatch", "event-outside-player-active-interval")
    rows = a.join(b, ["source", "event"]).select("person", "player", state.alias("state"), conflict.alias("conflict"), F.least("a_confidence", "b_confidence").alias("confidence"))
    listed = lambda when: F.array_sort(F.collect_set(F.when(when, col("state"))))
    return rows.groupBy("person", "player").agg(
        F.max(F.when(col("state").isNull(), col("confidence"))).alias("event_conf"),
        listed(col("conflict")).alias("event_conflicts"),
        listed(~col("conflict")).alias("event_reasons"),
    )
