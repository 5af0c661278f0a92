"""The binning operator over a stream: bins close when the watermark has passed their end.

An extension of the batch operator: observations are a static table, events a stream.  The time
column is a zoned timestamp, as watermarks need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import aggregated


def stream_binned(events: DataFrame, obs: DataFrame, *, seconds: int, count: int, field: str = "value", strategy: str = "last", delay: str = "1 hour", order: str = "event_id") -> DataFrame:
    """obs_id, concept, interval_step, bin_start, value and n_events, one row for each bin.

    events: person_id, concept, at (timestamp), the field and the order column.  The watermark follows the
    bins' starts, a bin's length and ``delay`` behind the latest event.
    """
    rows = events.join(obs.select("obs_id", "person_id", F.col("start_date").cast("timestamp").alias("_zero")), "person_id")
    length = F.lit(seconds * 1_000_000)
    step = F.floor((F.unix_micros("at") - F.unix_micros("_zero")) / length)
    rows = rows.withColumn("interval_step", step.cast("int")).withColumn("bin_start", F.timestamp_micros(F.unix_micros("_zero") + step * length))
    # the condition names bin_start, so that it stays above the watermark, which events outside the bins move too
    inside = F.when(F.col("bin_start").isNotNull(), F.col("interval_step").between(0, count - 1))
    rows = rows.withWatermark("bin_start", f"{delay} {seconds} seconds").where(inside)
    value = aggregated(strategy, field, [F.col("at"), F.col(order)])
    return rows.groupBy("obs_id", "concept", "interval_step", "bin_start").agg(value.alias("value"), F.count("*").alias("n_events"))
