"""Cohorts against plain Python: nulls, windows on both sides, combinations, attrition in one pass."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolake.operators.cohort import AtLeast, Events, attrition, cohort, flagged, index_times

ZERO = datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(40)]), rng.choice(["a", "b", "c", None]), rng.choice([None, *(ZERO + timedelta(hours=rng.randint(0, 500)) for _ in range(9))])) for _ in range(900)]
    dead = [(3,), (4,), (None,), (5,), (5,)]
    return rows, dead, spark.createDataFrame(rows, "who int, kind string, at timestamp_ntz"), spark.createDataFrame(dead, "person_id int")


def by_force(rows, dead):
    index = {}
    for who, kind, at in rows:
        if who is not None and kind == "a" and at is not None:
            index[who] = min(index.get(who, at), at)
    out = {}
    for who, start in index.items():
        own = [(k, t) for w, k, t in rows if w == who]
        near = lambda lo, hi, kind, own=own, start=start: sum(k == kind and t is not None and start + timedelta(days=lo) <= t <= start + timedelta(days=hi) for k, t in own)
        later = sum(k == "c" and t is not None and t >= start + timedelta(hours=6) for k, t in own)
        two, early = near(-5, 5, "b") >= 2, near(-10_000, -1, "c") > 0
        out[who] = (start, two, not early, two or (later > 0 and who not in {d[0] for d in dead}), who not in {d[0] for d in dead})
    return out


def steps(events, deaths):
    kind = F.col("kind")
    two, early, later = AtLeast(events, kind == "b", n=2, after=-5, before=5), AtLeast(events, kind == "c", before=-1), AtLeast(events, kind == "c", after=6, unit="h")
    alive = ~AtLeast(deaths)
    return {"two": two, "not early": ~early, "either": two | (later & alive), "alive": alive}


def test_members_and_attrition(people):
    rows, dead, frame, deaths = people
    events = Events(frame, "at", "who")
    index = index_times(events, F.col("kind") == "a")
    want = by_force(rows, dead)
    named = steps(events, Events(deaths))
    got = {r["person_id"]: tuple(r)[1:] for r in flagged(index, named).collect()}
    assert got == want and 3 < sum(all(v[1:]) for v in want.values()) < len(want)
    assert {r["person_id"] for r in cohort(index, named).collect()} == {w for w, v in want.items() if all(v[1:])}
    lost = []
    for k in range(5):
        left = sum(all(v[1 : k + 1]) for v in want.values())
        before = sum(all(v[1:k]) for v in want.values())
        lost.append((k, ["all", *named][k], left, before - left if k else 0, sum(not v[k] for v in want.values()) if k else 0))
    out = attrition(index, named)
    assert [tuple(r) for r in out.orderBy("step").collect()] == lost
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 5, "two tables of events, read once for all steps, and the index times for the persons and for each of them"


def test_no_persons_and_wrong_criteria(people, spark):
    _, _, frame, deaths = people
    events = Events(frame, "at", "who")
    nobody = index_times(events, F.col("kind") == "z")
    assert [tuple(r) for r in attrition(nobody, steps(events, Events(deaths))).collect()] == [(k, n, 0, 0, 0) for k, n in enumerate(["all", "two", "not early", "either", "alive"])]
    for bad in (lambda: AtLeast(events, n=0), lambda: AtLeast(Events(deaths), after=1), lambda: AtLeast(events, after=1, unit="month")):
        with pytest.raises(ValueError):
            bad()
