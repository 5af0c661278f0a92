"""The binning operator: events of each observation in its own fixed intervals.

Steps come from integer arithmetic on the distance to the observation's time zero, so that the join
of bins and events is an equality join, and events are aggregated before anything is made dense.
Point events join on the person and a coarse stretch of time as long as all bins of an
observation, which touches two of them at most; so a person with many observations meets an event
at most with those around it.  Spans join on the person and the dyadic stretches that tile them (intervals).  An
observation's end never clips its bins unless clip_to_end is set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import aggregated, as_time, covered_steps, elapsed, point_step, stretch
from .intervals import overlapping
from .selection import medians, modes

KEYS = ["obs_id", "person_id", "concept"]
#: Strategies whose built-in holds all values of a bin, and events, at most, for which it is taken.
_SELECTED = {"median": medians, "mode": modes}
HOT = 1_000_000


def binned(
    obs: DataFrame,
    events: DataFrame,
    *,
    length: int,
    count: int,
    fields: Sequence[str],
    strategy: str = "last",
    last_fields: Sequence[str] = (),
    span: bool = False,
    order: Sequence[str] = (),
    clip_to_end: bool = False,
) -> DataFrame:
    """obs_id, person_id, concept, interval_step, is_present and the fields of bins that have an event.

    obs: obs_id, person_id, start_date, end_date.  events: person_id, concept, at, until (spans)
    and fields; order names the columns that break ties of equal times.
    """
    base = obs.select("obs_id", "person_id", as_time("start_date").alias("_zero"), as_time("end_date").alias("_stop"))
    rows = events.withColumn("_at", as_time("at"))
    rows = rows.where(F.col("concept").isNotNull())
    if span:
        until = as_time("until")
        rows = rows.withColumns({"_low": F.least("_at", until), "_high": F.greatest("_at", until)})
        rows = overlapping(base, rows, width=length * count)
    else:
        here = stretch(F.col("_zero"), length * count)
        base = base.withColumn("_stretch", F.explode(F.array(here, here + 1)))
        rows = rows.withColumn("_stretch", stretch(F.col("_at"), length * count)).join(base, ["person_id", "_stretch"])
    if clip_to_end:
        rows = rows.where(F.col("_at") <= F.col("_stop"))
    if span:
        steps = covered_steps(F.col("_zero"), F.col("_at"), as_time("until"), length, count)
        rows = rows.withColumn("interval_step", F.explode(steps))
    else:
        # one comparison of distances drops what no bin can hold before the division
        inside = elapsed(F.col("_zero"), F.col("_at")).between(0, length * count - 1)
        rows = rows.where(inside).withColumn("interval_step", point_step(F.col("_zero"), F.col("_at"), length))
    by = [F.col("_at"), *map(F.col, order)]
    fields = [f for f in fields if f != "is_present"]
    keys = [*KEYS, "interval_step"]
    # a bin has no more values than there are events, so that tables of few need no other way
    apart = list(fields) if strategy in _SELECTED and not _at_most(events, HOT) else []
    value: list[Column] = [aggregated(strategy, f, by).alias(f) for f in fields if f not in apart]
    value += [aggregated("last", f, by).alias(f) for f in last_fields]
    out = rows.groupBy(*keys).agg(F.max(F.lit(1)).alias("is_present"), *value)
    for f in apart:
        out = out.join(_SELECTED[strategy](rows, keys, f), keys)
    return out.select(*keys, "is_present", *fields, *last_fields)


def _at_most(events: DataFrame, n: int) -> bool:
    return events.limit(n + 1).count() <= n


def backbone(obs: DataFrame, concepts: DataFrame, count: int) -> DataFrame:
    """Every observation with every concept and every step.

    Steps are generated row by row from the observations and concepts; no step table is joined.
    """
    pairs = obs.select("obs_id", "person_id", as_time("start_date").alias("_zero")).crossJoin(concepts.select("concept"))
    return pairs.withColumn("interval_step", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def dense(obs: DataFrame, concepts: DataFrame, cells: DataFrame, *, length: int, count: int, strategy: str = "last", fields: Sequence[str] = ()) -> DataFrame:
    """All bins with their start and end; empty ones hold NULL, or 0 where the strategy counts."""
    size = F.make_dt_interval(secs=(F.lit(length) / F.lit(1_000_000)).cast("decimal(18,6)"))
    all_bins = backbone(obs, concepts, count)
    out = all_bins.join(cells.drop("person_id"), ["obs_id", "concept", "interval_step"], "left")
    start = F.col("_zero") + size * F.col("interval_step")
    named = [F.coalesce(F.col(f), F.lit(0)).alias(f) if strategy == "count" and f in fields else F.col(f) for f in cells.columns if f not in (*KEYS, "interval_step")]
    return out.select("obs_id", "person_id", "concept", "interval_step", start.alias("interval_start"), (start + size).alias("interval_end"), *named)
