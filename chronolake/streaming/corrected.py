"""Bins that late events correct, over two streams, by arbitrary state.

Observations and events are both streams, and either may come first.  A person's state holds its observations, the events of
the last ``keep`` and one entry for each bin: count, sums and the rows that its strategy asks for, not the
events.  An event changes the bins of the observations that are there, at once and however late it is; an observation that comes
later takes the events that are still kept.  Each change emits the bin anew with a higher revision, so that the last revision
of each bin equals the batch operator on the same rows.  A timer forgets events after ``keep``; bins stay.  Timers ask for
batches without data, so that a query with an availableNow trigger ends only if spark.sql.streaming.noDataMicroBatches.enabled is off.

State lies in RocksDB, by person, and its maps are read entry by entry, so that memory does not grow with a person's events.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRATEGIES = ("last", "first", "sum", "mean", "min", "max", "count")
OUTPUT = "person_id long, obs_id long, concept string, interval_step int, value double, n_events long, revision long"
_BIN = "n long, known long, total double, least double, most double, first_at long, first_id long, first double, last_at long, last_id long, last double, revision long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _taken(held: tuple | None, at: int, event: int, value: float | None) -> tuple:
    """A bin's entry with one more event; ties of times go by the event's id."""
    n, known, total, least, most, first_at, first_id, first, last_at, last_id, last, revision = held or (0, 0, 0.0, None, None, None, None, None, None, None, None, 0)
    if value is not None:
        known, total = known + 1, total + value
        least, most = (value if least is None else min(least, value)), (value if most is None else max(most, value))
    if first_at is None or (at, event) < (first_at, first_id):
        first_at, first_id, first = at, event, value
    if last_at is None or (at, event) > (last_at, last_id):
        last_at, last_id, last = at, event, value
    return n + 1, known, total, least, most, first_at, first_id, first, last_at, last_id, last, revision


def _result(held: tuple, strategy: str) -> float | None:
    _, known, total, least, most, _, _, first, _, _, last, _ = held
    if strategy == "count":
        return float(known)
    if strategy in ("first", "last"):
        return first if strategy == "first" else last
    if not known:
        return None
    return {"sum": total, "mean": total / known, "min": least, "max": most}[strategy]


class Bins(StatefulProcessor):
    """The state of one person."""

    def __init__(self, length: int, count: int, strategy: str, keep_ms: int):
        self.length, self.count, self.strategy, self.keep_ms = length, count, strategy, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.obs = handle.getMapState("obs", "obs_id long", "zero long")
        self.events = handle.getMapState("events", "event_id long", "concept string, at long, value double, until long")
        self.bins = handle.getMapState("bins", "obs_id long, concept string, step int", _BIN)

    def _take(self, changed: set, obs_id: int, zero: int, event: int, concept: str, at: int, value: float | None) -> None:
        step = (at - zero) // self.length
        if 0 <= step < self.count:
            key = (obs_id, concept, int(step))
            held = self.bins.getValue(key) if self.bins.containsKey(key) else None
            self.bins.updateValue(key, _taken(held, at, event, value))
            changed.add(key)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        now = timerValues.getCurrentProcessingTimeInMs()
        changed: set = set()
        some = False
        for frame in rows:
            frame = frame.astype(object).where(frame.notna(), None)
            for r in frame.itertuples(index=False):
                if r.is_obs:
                    if self.obs.containsKey((r.row_id,)):
                        continue
                    self.obs.updateValue((r.row_id,), (r.at,))
                    for (event,), (concept, at, value, _) in self.events.iterator():
                        self._take(changed, r.row_id, r.at, event, concept, at, value)
                elif not self.events.containsKey((r.row_id,)):
                    self.events.updateValue((r.row_id,), (r.concept, r.at, r.value, now + self.keep_ms))
                    some = True
                    for (obs_id,), (zero,) in self.obs.iterator():
                        self._take(changed, obs_id, zero, r.row_id, r.concept, r.at, r.value)
        if some:
            self.handle.registerTimer(now + self.keep_ms)
        out = []
        for bin_ in sorted(changed):
            held = tuple(self.bins.getValue(bin_))
            held = (*held[:-1], held[-1] + 1)
            self.bins.updateValue(bin_, held)
            out.append((key[0], *bin_, _result(held, self.strategy), held[0], held[-1]))
        yield pd.DataFrame(out, columns=["person_id", "obs_id", "concept", "interval_step", "value", "n_events", "revision"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for event in [k for k, v in self.events.iterator() if v[3] <= now]:
            self.events.removeKey(event)
        return iter(())

    def close(self) -> None:
        pass


def stream_corrected(events: DataFrame, obs: DataFrame, *, seconds: int, count: int, field: str = "value", strategy: str = "last", keep_seconds: int = 7 * 86_400) -> DataFrame:
    """person_id, obs_id, concept, interval_step, value, n_events and revision: bins as they change, to be written in update mode.

    events: person_id, concept, at, event_id and the field; obs: person_id, obs_id, start_date; both streams.  An event that
    comes again (by its id, while it is kept) does not count twice.  Rows without person, time, concept or id are left out.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    spark = events.sparkSession
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    left = events.select(F.col("person_id").cast("long").alias("person_id"), F.lit(False).alias("is_obs"), F.col("event_id").cast("long").alias("row_id"), F.col("concept").cast("string").alias("concept"), micros("at").alias("at"), F.col(field).cast("double").alias("value"))
    right = obs.select(F.col("person_id").cast("long").alias("person_id"), F.lit(True).alias("is_obs"), F.col("obs_id").cast("long").alias("row_id"), F.lit(None).cast("string").alias("concept"), micros("start_date").alias("at"), F.lit(None).cast("double").alias("value"))
    rows = left.where(F.col("concept").isNotNull()).unionByName(right).where("person_id IS NOT NULL AND at IS NOT NULL AND row_id IS NOT NULL")
    processor = Bins(seconds * 1_000_000, count, strategy, keep_seconds * 1000)
    return rows.groupBy("person_id").transformWithStateInPandas(processor, OUTPUT, "Update", "ProcessingTime")
