"""Cohorts: persons by inclusion, exclusion and gaps in time, with the attrition of each step.

A criterion counts qualifying events of a person, within a window around the person's index time where it has one.  The
algebra is boolean: & and | and ~ of criteria.  The index time is the first event of a kind.  A definition compiles to one plan: all
events that any criterion reads are joined to the index times and summed up in one aggregation by person, with a
conditional count for each leaf; from the counts each step is one bit of a person's flags, and attrition is one
aggregation of the flags.  A person has one index time, so that the join of one with very many events can be split.

Null-aware: an event without person excludes nobody, as a null in a NOT IN list would; one without time counts only for criteria
without window.  A person without index time has no row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import as_time, elapsed
from ..functions.spec import microseconds


@dataclass(frozen=True)
class Events:
    """Events that criteria read: a table with a person, and a time where windows are asked for."""

    rows: DataFrame
    at: str | None = None
    person: str = "person_id"


class Criterion:
    """A condition on a person; & | ~ combine them."""

    def __and__(self, other: Criterion) -> Criterion:
        return Combined(lambda a, b: a & b, (self, other))

    def __or__(self, other: Criterion) -> Criterion:
        return Combined(lambda a, b: a | b, (self, other))

    def __invert__(self) -> Criterion:
        return Combined(lambda a: ~a, (self,))

    def leaves(self) -> list[AtLeast]:
        raise NotImplementedError

    def holds(self, count: Callable[[AtLeast], Column]) -> Column:
        raise NotImplementedError


@dataclass(frozen=True, eq=False)
class AtLeast(Criterion):
    """At least n events that meet a condition (all, without one), between after and before the index time, both included.

    after and before are numbers of a unit of fixed length, negative before the index; None leaves that side open.
    """

    events: Events
    condition: Column | None = None
    n: int = 1
    after: float | None = None
    before: float | None = None
    unit: str = "day"

    def __post_init__(self):
        if self.n < 1:
            raise ValueError("n must be 1 at least")
        if (self.after is not None or self.before is not None) and self.events.at is None:
            raise ValueError("a window needs events with a time")
        microseconds(1, self.unit)

    def leaves(self) -> list[AtLeast]:
        return [self]

    def holds(self, count):
        return count(self) >= self.n

    def qualifies(self, index: Column) -> Column:
        out = self.condition if self.condition is not None else F.lit(True)
        size = microseconds(1, self.unit)
        if self.after is not None or self.before is not None:
            gap = elapsed(index, as_time(self.events.at))
            if self.after is not None:
                out = out & (gap >= F.lit(int(self.after * size)))
            if self.before is not None:
                out = out & (gap <= F.lit(int(self.before * size)))
        return F.coalesce(out, F.lit(False))


@dataclass(frozen=True, eq=False)
class Combined(Criterion):
    combine: Callable[..., Column]
    parts: tuple[Criterion, ...]

    def leaves(self) -> list[AtLeast]:
        return [leaf for p in self.parts for leaf in p.leaves()]

    def holds(self, count):
        return self.combine(*(p.holds(count) for p in self.parts))


def index_times(events: Events, condition: Column | None = None) -> DataFrame:
    """person_id and index: the time of each person's first event that meets a condition."""
    rows = events.rows if condition is None else events.rows.where(condition)
    return rows.where(F.col(events.person).isNotNull()).groupBy(F.col(events.person).alias("person_id")).agg(F.min(as_time(events.at)).alias("index")).where("index IS NOT NULL")


def flagged(index: DataFrame, steps: dict[str, Criterion]) -> DataFrame:
    """person_id, index, and a flag for each step; index has a row for each person."""
    tables: dict[int, tuple[Events, list[AtLeast]]] = {}
    for leaf in dict.fromkeys(leaf for step in steps.values() for leaf in step.leaves()):
        tables.setdefault(id(leaf.events), (leaf.events, []))[1].append(leaf)
    out, name = index.select("person_id", "index"), {}
    for k, (events, leaves) in enumerate(tables.values()):
        rows = events.rows.withColumnRenamed(events.person, f"_person{k}").where(F.col(f"_person{k}").isNotNull())
        start = index.select(F.col("person_id").alias("_of"), F.col("index").alias("_index"))
        met = rows.join(start, F.col(f"_person{k}") == F.col("_of"))
        for j, leaf in enumerate(leaves):
            name[leaf] = f"_n{k}_{j}"
        counts = met.groupBy("_of").agg(*(F.count_if(leaf.qualifies(F.col("_index"))).alias(name[leaf]) for leaf in leaves))
        out = out.join(counts, F.col("person_id") == F.col("_of"), "left").drop("_of")
    count = lambda leaf: F.coalesce(name[leaf], F.lit(0))
    return out.select("person_id", "index", *(step.holds(count).alias(title) for title, step in steps.items()))


def cohort(index: DataFrame, steps: dict[str, Criterion]) -> DataFrame:
    """person_id and index of the persons who pass all steps."""
    met = reduce(lambda a, b: a & b, (F.col(f"`{s}`") for s in steps), F.lit(True))
    return flagged(index, steps).where(met).select("person_id", "index")


def attrition(index: DataFrame, steps: dict[str, Criterion]) -> DataFrame:
    """step, name, n (persons left after it), lost (by it) and alone (who fail it whatever else), in one pass over flags as bits.

    Step 0 has all persons.
    """
    names = list(steps)
    if len(names) > 62:
        raise ValueError("there are 62 steps at most")
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(~F.col(f"`{s}`"), F.lit(1 << k)).otherwise(0).cast("bigint") for k, s in enumerate(names)), F.lit(0).cast("bigint"))
    kinds = flagged(index, steps).groupBy(bits.alias("_fails")).agg(F.count("*").alias("_persons"))
    rows = []
    for k in range(len(names) + 1):
        upto, before = (1 << k) - 1, (1 << max(k - 1, 0)) - 1
        left = F.sum(F.when(F.col("_fails").bitwiseAND(upto) == 0, F.col("_persons")).otherwise(0))
        at_start = F.sum(F.when(F.col("_fails").bitwiseAND(before) == 0, F.col("_persons")).otherwise(0))
        alone = F.sum(F.when(F.col("_fails").bitwiseAND(F.lit(1 << (k - 1))) != 0, F.col("_persons")).otherwise(0)) if k else F.lit(0).cast("bigint")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
        rows.append(F.struct(F.lit(k).alias("step"), F.lit(names[k - 1] if k else "all").alias("name"), zero(left).alias("n"), zero(at_start - left).alias("lost"), zero(alone).alias("alone")))
    return kinds.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))
