"""Column expressions over numbers. Null means unknown; it is never replaced by a default."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once, however often ``of`` names it."""
    return F.element_at(F.transform(F.array(value), lambda v: of(v)), 1)


def finite(value: Column) -> Column:
    """The number, or null if it is no number, NaN or infinite."""
    v = value.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def clamp(value: Column, low: float, high: float) -> Column:
    """``least`` and ``greatest`` skip nulls, so a null value is guarded."""
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    """0 where both are 0, null where either is."""
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def half_up_index(value: Column) -> Column:
    """floor(x + 0.5)."""
    return F.floor(value + 0.5)


def smoothstep(value: Column) -> Column:
    p = clamp(value, 0.0, 1.0)
    return p * p * (3 - 2 * p)


def hypot(dx: Column, dy: Column) -> Column:
    """sqrt of the sum of squares, as other engines write it."""
    return F.sqrt(dx * dx + dy * dy)


def lerp(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share


def higher_is_better(value: Column, good: float, fair: float) -> Column:
    """pass / review / reject, bounds included; unknown for null."""
    return F.when(value.isNull(), "unknown").when(value >= good, "pass").when(value >= fair, "review").otherwise("reject")


def lower_is_better(value: Column, good: float, fair: float) -> Column:
    return F.when(value.isNull(), "unknown").when(value <= good, "pass").when(value <= fair, "review").otherwise("reject")
