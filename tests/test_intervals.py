"""The overlap join of windows and spans, and binning of spans, against all pairs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolake.operators import intervals
from chronolake.operators.binning import binned

DAY = 86_400_000_000
ZERO = datetime(2020, 1, 1)
WINDOWS, SPANS = "person_id int, w int, _zero timestamp_ntz", "person_id int, s int, _low timestamp_ntz, _high timestamp_ntz"


def frames(spark, windows, spans):
    return spark.createDataFrame(windows, WINDOWS), spark.createDataFrame(spans, SPANS)


@pytest.mark.parametrize("width", [1, 7_000_000, 3_600_000_000, 10 * DAY])
def test_against_all_pairs(spark, width):
    """Short and long spans, points, borders that touch, times before 1970, null times, several persons."""
    rng = random.Random(width)
    step = max(width // 7, 1)
    at = lambda k: ZERO + timedelta(microseconds=k * step)
    windows = [(p, k, at(rng.randint(-60, 60))) for k, p in enumerate([1, 2] * 60)]
    spans = []
    for k in range(200):
        a = rng.randint(-80, 80)
        spans.append((rng.choice([1, 2, 3]), k, at(a), at(a + rng.choice([0, 0, 1, 2, 7, 8, 50, 100_000, 9_000_000 if width < DAY else 3000]))))
    windows += [(1, 900, ZERO - timedelta(days=30_000)), (None, 901, at(0)), (1, 902, None)]
    spans += [(1, 900, ZERO - timedelta(days=40_000), ZERO - timedelta(days=20_000)), (1, 901, None, at(0)), (1, 902, at(0), None), (None, 903, at(0), at(1))]
    got = [(r["w"], r["s"]) for r in intervals.overlapping(*frames(spark, windows, spans), width=width).collect()]
    size = timedelta(microseconds=width)
    want = [(w, s) for p, w, z in windows for q, s, a, b in spans if p == q and None not in (p, z, a, b) and a < z + size and b >= z]
    assert len(got) == len(set(got)) and set(got) == set(want)


def test_tiles_are_disjoint_and_few(spark):
    rng = random.Random(1)
    rows = [(a, a + n) for a, n in ((rng.randint(-1000, 1000), rng.choice([0, 1, 5, 100, 5000])) for _ in range(200))]
    out = spark.createDataFrame(rows, "a long, b long").withColumn("t", intervals.tiles(F.col("a"), F.col("b"), 8)).collect()
    for r in out:
        grains = [g for level, s in r["t"] for g in range(s << level, (s + 1) << level)]
        assert sorted(grains) == list(range(r["a"], r["b"] + 1))
        assert len(r["t"]) <= 2 * 8 + (r["b"] - r["a"] + 1) // 256


def test_a_hot_person_is_dealt_out(spark):
    """1,000 overlapping observations of one person, spans of a year: little is joined that is no pair, and keys are many."""
    rng = random.Random(2)
    windows = [(1, k, ZERO + timedelta(hours=8 * k)) for k in range(1000)]
    spans = [(1, k, ZERO + timedelta(hours=rng.randint(-4000, 12000)), None) for k in range(300)]
    spans = [(p, k, a, a + timedelta(days=365 if k % 3 == 0 else rng.randint(0, 3))) for p, k, a, _ in spans]
    left, right = frames(spark, windows, spans)
    out = intervals.overlapping(left, right, width=DAY)
    pairs = sum(a < z + timedelta(days=1) and b >= z for _, _, z in windows for _, _, a, b in spans)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == pairs and "CartesianProduct" not in plan
    met = count_before_filter(spark, left, right)
    assert met <= pairs * 1.5 + 16 * len(spans)
    # nearly all of 300 x 1000 would meet if a person's rows met in one task
    assert pairs < met < 300_000 / 2


def count_before_filter(spark, left, right):
    """Rows that the join makes, by its keys alone."""
    joined = intervals.overlapping(left, right, width=DAY)
    every = joined._jdf.queryExecution().analyzed()
    assert "Filter" in every.toString()
    grain, top = intervals.levels(DAY)
    number = lambda c: F.floor(intervals._epoch(F.col(c)) / grain).cast("bigint")
    day = lambda c: F.floor(intervals._epoch(F.col(c)) / DAY).cast("bigint")
    own = F.array(F.struct(F.lit(-1).alias("level"), day("_low").alias("stretch")))
    keys = right.select(F.explode(F.concat(own, intervals.tiles(number("_low"), number("_high"), top))).alias("k"))
    begins = [F.struct(F.lit(-1).alias("level"), (day("_zero") + k).alias("stretch")) for k in (0, 1)]
    places = left.select(F.explode(F.array(*begins, *(F.struct(F.lit(k).alias("level"), F.shiftright(number("_zero"), k).alias("stretch")) for k in range(top + 1)))).alias("k"))
    return keys.join(places, "k").count()


def overlaps(windows, spans, width):
    return {(w, s) for p, w, z in windows for q, s, a, b in spans if p == q and None not in (p, z, a, b) and a < z + width and b >= z}


def one_busy_person():
    """200 persons with two windows and three spans, and one with 40 windows and 60 spans, some of a year."""
    rng = random.Random(5)
    at = lambda: ZERO + timedelta(hours=rng.randint(-300, 300))
    windows = [(p, k, at()) for k, p in enumerate([*range(200)] * 2 + [999] * 40)]
    begins = [(p, k, at()) for k, p in enumerate([*range(200)] * 3 + [999] * 60)]
    return windows, [(p, k, a, a + timedelta(days=365 if k % 5 == 0 else rng.randint(0, 9))) for p, k, a in begins]


def executed(frame):
    """Nodes of the plan that ran, with what they measured."""
    def walk(node):
        yield node
        below = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else [node.children().apply(k) for k in range(node.children().size())]
        for x in below:
            yield from walk(x)

    frame.collect()
    return list(walk(frame._jdf.queryExecution().executedPlan()))


def test_one_busy_person_leaves_the_others_whole(spark):
    """Rows of persons with few windows are not multiplied because another person has many."""
    windows, spans = one_busy_person()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = intervals.overlapping(*frames(spark, windows, spans), width=DAY)
        made = sum(n.metrics().apply("shuffleRecordsWritten").value() for n in executed(out) if n.nodeName() == "Exchange")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    got = [(r["w"], r["s"]) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == overlaps(windows, spans, timedelta(days=1))
    # 40 windows and 60 spans in some 16 places each at most, all others in one
    assert made <= 200 * (2 + 3) + 16 * (40 + 60) + 1000


def test_places_of_windows_are_not_broadcast(spark):
    """Spark takes the places for as few rows as the windows, however small; the driver must not gather them."""
    windows, spans = one_busy_person()
    names = [n.nodeName() for n in executed(intervals.overlapping(*frames(spark, windows, spans), width=DAY))]
    assert "SortMergeJoin" in names


@pytest.mark.parametrize("named", [1, 2])
def test_more_busy_persons_than_a_broadcast_names(spark, monkeypatch, named):
    windows, spans = one_busy_person()
    windows += [(998, 1000 + k, ZERO + timedelta(hours=k)) for k in range(17)] + [(None, 2000 + k, ZERO) for k in range(20)] + [(999, 3000, None)]
    spans += [(998, 1000, ZERO, ZERO + timedelta(days=1)), (None, 1001, ZERO, ZERO), (999, 1002, None, ZERO), (5, 1003, windows[5][2], None)]
    monkeypatch.setattr(intervals, "NAMED", named)
    out = intervals.overlapping(*frames(spark, windows, spans), width=DAY)
    got = [(r["w"], r["s"]) for r in out.collect()]
    assert ("strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()) == (named == 2)
    assert out.columns == ["person_id", "s", "_low", "_high", "w", "_zero"]
    assert len(got) == len(set(got)) and set(got) == overlaps(windows, spans, timedelta(days=1))


def test_null_times_meet_nothing_where_nobody_is_busy(spark):
    windows, spans = [(1, 1, ZERO), (1, 2, None)], [(1, 1, ZERO, None), (1, 2, None, ZERO), (1, 3, ZERO, ZERO)]
    out = intervals.overlapping(*frames(spark, windows, spans), width=DAY)
    assert [(r["w"], r["s"]) for r in out.collect()] == [(1, 3)] and out.columns == ["person_id", "s", "_low", "_high", "w", "_zero"]


def test_binned_spans_of_many_observations(spark):
    """Steps of spans with missing and earlier ends, over observations that overlap."""
    rng = random.Random(3)
    obs = [(k, k % 2, ZERO + timedelta(hours=5 * k), ZERO) for k in range(200)]
    events = []
    for k in range(300):
        a = ZERO + timedelta(hours=rng.randint(-100, 1100), minutes=rng.randint(0, 59))
        b = rng.choice([None, a, a - timedelta(hours=rng.randint(1, 40)), a + timedelta(hours=rng.randint(1, 60)), a + timedelta(days=365)])
        events.append((k % 2, "c", a, b, float(k)))
    length, count = 6 * 3_600_000_000, 8
    got = binned(spark.createDataFrame(obs, "obs_id int, person_id int, start_date timestamp_ntz, end_date timestamp_ntz"), spark.createDataFrame(events, "person_id int, concept string, at timestamp_ntz, until timestamp_ntz, value double"), length=length, count=count, fields=["value"], strategy="sum", span=True)
    want = {}
    for o, p, zero, _ in obs:
        for q, _, a, b, v in events:
            if p != q:
                continue
            for step in range(count):
                lo, hi = zero + timedelta(hours=6 * step), zero + timedelta(hours=6 * step + 6)
                if lo <= a < hi or (b is not None and (lo <= b < hi or (a < lo and b >= hi))):
                    want[(o, step)] = want.get((o, step), 0.0) + v
    assert {(r["obs_id"], r["interval_step"]): r["value"] for r in got.collect()} == want
