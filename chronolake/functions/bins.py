"""Expressions of time binning: steps by integer arithmetic, and the aggregation strategies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_time(column: Column | str) -> Column:
    """Timestamp without zone; dates become midnight."""
    return (F.col(column) if isinstance(column, str) else column).cast("timestamp_ntz")


def elapsed(zero: Column, at: Column) -> Column:
    """Microseconds from zero to at."""
    return F.timestamp_diff("MICROSECOND", zero, at)


def _div(a: Column, b: Column) -> Column:
    """Division of integers, rounded towards 0."""
    return F.call_function("div", a, b)


def date_diff(unit: str, begin: Column, end: Column) -> Column:
    """Boundaries of a unit (year to second) that lie between two times; negative where end is earlier.

    Weeks are whole sevens of day boundaries, whatever the weekday, rounded towards 0.
    """
    if unit not in ("year", "quarter", "month", "week", "day", "hour", "minute", "second"):
        raise ValueError(f"unknown unit {unit!r}")
    if unit == "week":
        return _div(date_diff("day", begin, end), F.lit(7))
    a, b = (F.date_trunc(unit, as_time(x).cast("timestamp")) for x in (begin, end))
    return F.timestamp_diff(unit.upper(), a, b)


def point_step(zero: Column, at: Column, length: int) -> Column:
    """Number of whole lengths from zero to at, rounded down: intervals are [start, end)."""
    return _div(elapsed(zero, at) - F.pmod(elapsed(zero, at), F.lit(length).cast("long")), F.lit(length).cast("long")).cast("int")


def stretch(at: Column, width: int) -> Column:
    """Number of the stretch of time of the given width that a time lies in, counted from 1970."""
    since = elapsed(F.lit("1970-01-01").cast("timestamp_ntz"), at)
    return _div(since - F.pmod(since, F.lit(width).cast("long")), F.lit(width).cast("long"))


def closed_step(distance: Column, length: float) -> Column:
    """Step of right-closed intervals (start, end], with distance 0 in step 0."""
    return F.greatest(F.lit(0), F.ceil(distance / F.lit(float(length))).cast("int") - 1)


def covered_steps(zero: Column, begin: Column, end: Column, length: int, count: int) -> Column:
    """Steps that a span touches, its end included; with a missing or earlier end, the steps of its ends."""
    a, b = point_step(zero, begin, length), point_step(zero, end, length)
    inside = F.sequence(F.greatest(a, F.lit(0)), F.least(b, F.lit(count - 1)))
    touches = (b >= 0) & (a < count)
    ends = F.array_distinct(F.filter(F.array(a, b), lambda s: s.isNotNull() & (s >= 0) & (s < count)))
    none = F.array().cast("array<int>")
    return F.when(begin <= end, F.when(touches, inside).otherwise(none)).otherwise(ends)


def aggregated(strategy: str, column: str, order: list[Column]) -> Column:
    """The strategy's aggregate of a column; first and last go by time, then by the rest of order.

    A NULL time comes last, a NULL value of the first or last row is kept, a tied mode is the
    smallest value, and std is that of a sample.
    """
    key = F.struct(order[0].isNull(), *order)
    value = F.col(column)
    return {
        "last": lambda: F.max_by(value, key),
        "first": lambda: F.min_by(value, key),
        "mean": lambda: F.avg(value),
        "median": lambda: F.median(value),
        "mode": lambda: F.mode(value, True),
        "sum": lambda: F.sum(value),
        "count": lambda: F.count(value),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "std": lambda: F.stddev_samp(value),
    }[strategy]()
