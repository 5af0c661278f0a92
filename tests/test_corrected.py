"""Bins over two streams that late events and late observations correct, against the batch operator."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolake.operators.binning import binned
from chronolake.streaming.corrected import stream_corrected

ZERO = datetime(2020, 1, 1)
EVENT, OBS = "person_id long, concept string, at timestamp, value double, event_id long", "person_id long, obs_id long, start_date timestamp"


def test_late_rows_correct_the_bins(spark, tmp_path):
    """Four batches: events before their observation, out of order, days late, twice, without value; revisions rise."""
    rng = random.Random(3)
    events = [(k % 3, rng.choice("ab"), ZERO + timedelta(minutes=rng.randint(-200, 3000)), rng.choice([None, 1.0, 2.5, 4.0]), k) for k in range(240)]
    obs = [(p, 10 * p + j, ZERO + timedelta(hours=6 * j)) for p in range(3) for j in range(3)]
    batches = [(events[:80], obs[:4]), (events[80:160] + events[70:80], []), (events[160:220], obs[4:]), (events[220:] + [(9, "a", ZERO, 1.0, 900), (1, None, ZERO, 1.0, 901)], [])]
    seen = []
    # timers of processing time ask for batches without data, which a trigger that is to end would wait for
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    def run(k):
        for name, rows, schema in (("events", batches[k][0], EVENT), ("obs", batches[k][1], OBS)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams = [spark.readStream.schema(s).parquet(str(tmp_path / n)) for n, s in (("events", EVENT), ("obs", OBS))]
        out = stream_corrected(*streams, seconds=7200, count=12, strategy="last")
        query = out.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(90)

    for k in range(4):
        run(k)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    last, revisions = {}, {}
    for r in seen:
        key = (r["obs_id"], r["concept"], r["interval_step"])
        assert r["revision"] > revisions.get(key, 0)
        revisions[key], last[key] = r["revision"], (r["value"], r["n_events"])
    assert max(revisions.values()) >= 3, "bins were corrected"
    batch = binned(
        spark.createDataFrame(obs, OBS).withColumn("end_date", F.col("start_date")).withColumn("start_date", F.col("start_date").cast("timestamp_ntz")),
        spark.createDataFrame(events, EVENT).withColumn("at", F.col("at").cast("timestamp_ntz")).withColumn("one", F.lit(1)), length=7_200_000_000, count=12, fields=["value"], strategy="last", order=["event_id"],
    )
    want = {(r["obs_id"], r["concept"], r["interval_step"]): r["value"] for r in batch.collect()}
    assert {k: v[0] for k, v in last.items()} == want and len(want) > 60


@pytest.mark.parametrize("strategy", ["first", "sum", "mean", "min", "max", "count"])
def test_strategies(strategy):
    """Entries of a bin, without a stream: any order of events gives what the strategy says."""
    from chronolake.streaming.corrected import _result, _taken

    rows = [(5, 1, 2.0), (3, 2, None), (9, 3, -1.0), (3, 4, 7.0)]
    known = [2.0, -1.0, 7.0]
    want = {"first": None, "sum": 8.0, "mean": 8 / 3, "min": -1.0, "max": 7.0, "count": 3.0}[strategy]
    assert sum(known) == 8.0
    for turn in range(4):
        held = None
        for at, event, value in rows[turn:] + rows[:turn]:
            held = _taken(held, at, event, value)
        assert _result(held, strategy) == want and held[0] == 4


def test_wrong_strategy(spark):
    with pytest.raises(ValueError, match="strategy"):
        stream_corrected(spark.createDataFrame([], EVENT), spark.createDataFrame([], OBS), seconds=1, count=1, strategy="median")
