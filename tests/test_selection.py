"""Medians and modes of hot groups against the built-ins."""

import random

import pytest
from pyspark.sql import functions as F

from chronolake.functions.spec import DAY
from chronolake.operators import binning, selection

KEYS = ["obs_id", "step"]


def groups(spark, seed=0):
    """A hot group, small ones, one of ties, one of few values, wide ranges, nulls alone, a null key."""
    rng = random.Random(seed)
    rows = [(1, 0, rng.gauss(0, 1) * 10 ** rng.randint(-3, 9)) for _ in range(20_001)]
    rows += [(1, 1, float(rng.choice([1, 2, 2, 3]))) for _ in range(5_000)]
    rows += [(2, 0, 7.0)] * 4_000 + [(2, 1, 7.0)] * 3_000 + [(2, 1, 8.0 + k) for k in range(3_000)]
    rows += [(3, k % 50, float(rng.randint(0, 9))) for k in range(400)] + [(4, 0, None)] * 5 + [(4, 1, None), (4, 1, 2.0)]
    rows += [(None, 0, float(k)) for k in range(2_500)] + [(5, 0, float(k) / 2) for k in range(6_000)] + [(6, 0, -1.0 / (k + 1)) for k in range(2_001)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "obs_id int, step int, value double").repartition(5)


def table(df):
    return {tuple(r)[:2]: r["value"] for r in df.collect()}


@pytest.mark.parametrize(("limit", "cuts", "few"), [(100, 63, 10_000), (30, 7, 1), (10**9, 63, 10_000)])
def test_medians_equal_the_built_in(spark, monkeypatch, limit, cuts, few):
    """One and several rounds, with broadcast and salted bounds."""
    monkeypatch.setattr(selection, "LIMIT", limit)
    monkeypatch.setattr(selection, "CUTS", cuts)
    monkeypatch.setattr(selection, "FEW", few)
    rows = groups(spark)
    want = table(rows.groupBy(*KEYS).agg(F.median("value").alias("value")))
    assert table(selection.medians(rows, KEYS, "value")) == want
    assert len(want) > 55 and want[(4, 0)] is None


def test_modes_equal_the_built_in(spark):
    rows = groups(spark)
    assert table(selection.modes(rows, KEYS, "value")) == table(rows.groupBy(*KEYS).agg(F.mode("value", True).alias("value")))


def test_a_hot_bin_of_many_values(spark, monkeypatch):
    """Half a million distinct values of one bin: what is sorted in one task is below the limit."""
    monkeypatch.setattr(selection, "LIMIT", 1_000)
    sorted_, pick = [], selection._picked
    monkeypatch.setattr(selection, "_picked", lambda inside, ready, keys: (sorted_.extend(r["distinct"] for r in ready.collect()), pick(inside, ready, keys))[1])
    rows = spark.range(500_000).select(F.lit(1).alias("obs_id"), F.lit(0).alias("step"), (F.xxhash64("id").cast("double") * (1 + F.col("id") % 7)).alias("value"))
    got = table(selection.medians(rows, KEYS, "value"))[(1, 0)]
    below, above = rows.where(F.col("value") < got).count(), rows.where(F.col("value") > got).count()
    assert below == above == 250_000 and len(sorted_) == 1 and sorted_[0] <= 1_000


@pytest.mark.parametrize("strategy", ["median", "mode"])
def test_binned_takes_it_for_hot_bins(spark, monkeypatch, strategy):
    """Binning gives the same bins either way, with several fields, a last field and presence."""
    rng = random.Random(1)
    obs = spark.createDataFrame([(k, k, f"2020-01-0{k + 1}", "2021-01-01") for k in range(3)], "obs_id int, person_id int, start_date string, end_date string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_date", "end_date")})
    events = spark.range(6000).select((F.col("id") % 3).cast("int").alias("person_id"), F.when(F.col("id") % 5 > 0, "a").otherwise("b").alias("concept"), (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 7 % 5000).cast("int"))).alias("at"), F.when(F.col("id") % 11 > 0, F.xxhash64("id") % 50).cast("double").alias("value"), (F.col("id") % 13).cast("double").alias("other"), F.col("id").cast("string").alias("unit"))
    run = lambda: sorted((tuple(r) for r in binning.binned(obs, events, length=DAY, count=4, fields=["value", "other"], strategy=strategy, last_fields=["unit"], order=["unit"]).collect()), key=repr)
    want = run()
    monkeypatch.setattr(binning, "HOT", 100)
    monkeypatch.setattr(selection, "LIMIT", rng.choice([40, 60]))
    assert run() == want and len(want) > 15
