"""Overlap join of windows and spans of one person by dyadic stretches of time.

A window of fixed width and a span overlap if the span begins in the window, or the window begins in the
span, after the span's own begin; never both, so that each pair is found once.

* A begin lies in one stretch as wide as a window, and a window touches two of them.
* A span is cut into the largest dyadic stretches (grains, pairs of grains, pairs of those, ...) that tile it, about two for
  each doubling of its length, and a window's begin lies in one stretch of each size.  The tiles of a span are
  disjoint, so that a begin meets it in one of them at most.

Both are one equality join on (person, level, stretch), where the first kind has a level of its own.  A person with a thousand
windows and a million spans is dealt to many tasks, a year-long span takes a few rows more than one of a
day, and what is joined in vain lies within a grain of a span's ends.

Only busy persons, who have more than FEW windows, are tiled.  The spans of all others meet the windows of their person in one
place, so that neither has more rows than before the join, whoever else is busy.
"""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import elapsed, stretch

#: Grains of a window's width; fewer rows are joined in vain with more of them.
GRAINS = 2
#: Windows of a person, at most, for which its spans meet all of them: no more rows than tiles would make.
FEW = 16
#: Busy persons that a broadcast names; beyond them they are joined by a shuffle.
NAMED = 250_000
#: Levels of begins, and of the one place of persons who are not busy.
BEGIN, WHOLE = -1, -2
#: Grains of a span that are not put together to larger stretches.
SHORT = 4
#: Length of the largest stretches; longer spans are tiled by several of them.
LONGEST = 16 * 366 * 86_400_000_000


def _epoch(at: Column) -> Column:
    return elapsed(F.lit("1970-01-01").cast("timestamp_ntz"), at)


def levels(width: int) -> tuple[int, int]:
    """Microseconds of a grain, and the level of the largest stretches."""
    grain = max(width // GRAINS, 1)
    return grain, max(math.ceil(math.log2(LONGEST / grain)), 1)


def tiles(first: Column, last: Column, top: int) -> Column:
    """Structs (level, stretch) that tile the grains from first to last, both included.

    At level k the grains that whole stretches cover are those from ceil(first / 2**k) to floor((last + 1) / 2**k); the ends that no
    larger stretch takes are the odd ones.
    """
    # a span has no tiles above the level of its own length
    levels_ = F.sequence(F.lit(0), F.least(F.lit(top - 1), F.ceil(F.log2(last - first + 2)).cast("int")))

    def ends(k: Column) -> Column:
        a = F.call_function("shiftright", first + F.call_function("shiftleft", F.lit(1).cast("bigint"), k) - 1, k)
        b = F.call_function("shiftright", last + 1, k)
        odd = lambda end, s: F.struct(k.alias("level"), F.when((a < b) & (end.bitwiseAND(1) == 1), s).alias("stretch"))
        return F.array(odd(a, a), odd(b, b - 1))

    below = F.filter(F.flatten(F.transform(levels_, ends)), lambda t: t["stretch"].isNotNull())
    a, b = F.shiftright(first + F.lit((1 << top) - 1), top), F.shiftright(last + 1, top)
    largest = F.transform(F.sequence(a, b - 1), lambda s: F.struct(F.lit(top).alias("level"), s.alias("stretch")))
    # the grains of a short span are as few as its tiles, and quicker made
    grains = F.transform(F.sequence(first, last), lambda s: F.struct(F.lit(0).alias("level"), s.alias("stretch")))
    return F.when(last - first < SHORT, grains).when(a < b, F.concat(below, largest)).otherwise(below)


def overlapping(windows: DataFrame, spans: DataFrame, *, width: int, zero: str = "_zero", low: str = "_low", high: str = "_high", by: str = "person_id") -> DataFrame:
    """Spans with the windows of their person that they overlap; all columns of both, each pair once.

    Windows begin at zero and are width microseconds long, their end excluded; spans go from low to high, both included.
    Null times meet nothing.  Times are timestamps without zone; the names level, stretch, _busy and _end are taken.
    """
    windows = windows.withColumn("_end", F.col(zero) + F.lit(timedelta(microseconds=width)))
    spans = spans.where(F.col(low).isNotNull() & F.col(high).isNotNull())
    begins_here = elapsed(F.col(zero), F.col(low)).between(0, width - 1)
    begun_before = (F.col(low) < F.col(zero)) & (F.col(zero) <= F.col(high))
    # both at once and by comparisons alone, which are quick: they see all windows of a person
    either = (F.col(low) < F.col("_end")) & ((F.col(zero) <= F.col(low)) | (F.col(zero) <= F.col(high)))
    busy = windows.where(F.col(by).isNotNull()).groupBy(by).count().where(F.col("count") > FEW).select(by, F.lit(True).alias("_busy"))
    named = busy.count()
    if not named:
        return spans.join(windows, by).where(either).drop("_end")
    busy = F.broadcast(busy) if named <= NAMED else busy.hint("merge")
    grain, top = levels(width)
    number = lambda at: F.floor(_epoch(at) / F.lit(grain)).cast("bigint") if grain == 1 else stretch(at, grain)
    place = lambda k, s: F.struct(F.lit(k).alias("level"), s.alias("stretch"))
    tiled = F.col("_busy").isNotNull()
    whole = F.array(place(WHOLE, F.lit(0).cast("bigint")))
    here = stretch(F.col(zero), width)
    places = [place(BEGIN, here), place(BEGIN, here + 1)] + [place(k, F.shiftright(number(F.col(zero)), k)) for k in range(top + 1)]
    left = windows.where(F.col(zero).isNotNull()).join(busy, by, "left")
    left = left.withColumn("_place", F.explode(F.when(tiled, F.array(*places)).otherwise(whole))).select("*", "_place.*").drop("_place", "_busy")
    right = spans.join(busy, by, "left")
    right = right.withColumns({"_own": F.when(tiled, stretch(F.col(low), width)), "_first": F.when(tiled, number(F.col(low))), "_last": F.when(tiled, number(F.col(high)))})
    inside = F.when(F.col(low) < F.col(high), tiles(F.col("_first"), F.col("_last"), top)).otherwise(F.array().cast("array<struct<level: int, stretch: bigint>>"))
    right = right.withColumn("_place", F.explode(F.when(tiled, F.concat(F.array(place(BEGIN, F.col("_own"))), inside)).otherwise(whole)))
    right = right.select("*", "_place.*").drop("_place", "_busy", "_own", "_first", "_last")
    # Spark takes the places of windows for as many rows as there are windows: they are never to be broadcast
    met = right.join(left.hint("merge"), [by, "level", "stretch"])
    fits = F.when(F.col("level") == WHOLE, either).when(F.col("level") == BEGIN, begins_here).otherwise(begun_before)
    return met.where(fits).drop("level", "stretch", "_end")
