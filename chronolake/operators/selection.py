"""Exact medians and modes of groups of any size in bounded memory.

Spark's own median holds all distinct values of a group in one task.  Here the values of a group of more than LIMIT are
counted by (group, value), which deals them to all tasks, and narrowed in rounds: mergeable sketches of bounded size
cut each group's distinct values into CUTS + 1 ranges, the ranges' counts are summed by task before they are
shuffled, and the ranges that hold the ranks in question stay.  A round leaves about a thirtieth of the distinct values, however they are
spread and however often they repeat; what is left of them is sorted and looked up by rank.  Groups of fewer values
take the built-in, so that nothing changes for tables without a hot group.

A mode is the largest of the counts by value: they are made by (group, value), so that a hot group's values are dealt to
all tasks, and only the best count of each task's share is shuffled on.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir

#: Distinct values of a group, at most, that one task holds.
LIMIT = 250_000
#: Cuts of a group in a round, one less than a power of 2, and the accuracy of their ranks.
CUTS, ACCURACY = 63, 10_000
#: Large groups whose bounds are broadcast, at most; beyond that they are joined by a shuffle, salted.
FEW, SALTS = 10_000, 64


def _written(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/selection-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _equal(left: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of keys with those of the right side, named _key0, _key1, ...; null equals null."""
    out = F.lit(True)
    for k, name in enumerate(keys):
        out = out & left[name].eqNullSafe(F.col(f"_key{k}"))
    return out


def _with_bounds(rows: DataFrame, bounds: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of the groups that bounds has, with its columns; a hot group's rows stay dealt out."""
    right = bounds.select(*(F.col(c).alias(f"_key{k}") for k, c in enumerate(keys)), *columns)
    if right.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(right), _equal(rows, keys)).select(*rows.columns, *columns)
    rows = rows.withColumn("_salt", (F.rand(7) * SALTS).cast("int"))
    right = right.withColumn("_salts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(right, _equal(rows, keys) & (F.col("_salt") == F.col("_salts"))).select(*[c for c in rows.columns if c != "_salt"], *columns)


def modes(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """keys and the most frequent value of each group, the smallest of several; null values do not count, and make null where alone."""
    counts = rows.groupBy(*keys, column).agg(F.count(column).alias("_n"))
    best = F.min(F.when(F.col("_n") > 0, F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))))
    return counts.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.col("_best.v").alias(column))


def _range(low: int, high: int) -> Column:
    """Number of cuts from low to high - 1 that lie below v, and of those before: a search by halves."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(F.col("v") <= F.get("_cuts", F.lit(middle)), _range(low, middle)).otherwise(_range(middle + 1, high))


def _narrowed(inside: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A round: of each group the first and last value of the ranges that hold its ranks, their distinct values, and the count below."""
    shares = [(k + 1) / (CUTS + 1) for k in range(CUTS)]
    cuts = inside.groupBy(*keys).agg(F.percentile_approx("v", shares, ACCURACY).alias("_cuts"))
    cuts = cuts.select(*(F.col(c).alias(f"_key{k}") for k, c in enumerate(keys)), "_cuts")
    known = ["first", "last", "below"]
    bounds = _written(state.join(cuts, _equal(state, keys)).select(*keys, *known, "_cuts"))
    ranges = _with_bounds(inside, bounds, keys, [*known, "_cuts"]).groupBy(*keys, *known, _range(0, CUTS).alias("_range"))
    ranges = ranges.agg(F.sum("n").alias("_n"), F.count("*").alias("_distinct"), F.min("v").alias("_low"), F.max("v").alias("_high"))
    # a group has CUTS + 1 rows at most here
    upto = F.col("below") + F.sum("_n").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, 0))
    hit = ranges.withColumn("_upto", upto).where((F.col("_upto") >= F.col("first")) & (F.col("_upto") - F.col("_n") < F.col("last")))
    out = hit.groupBy(*keys, "first", "last").agg(F.min(F.col("_upto") - F.col("_n")).alias("below"), F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.sum("_distinct").alias("distinct"))
    return _written(out)


def medians(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """keys and the exact median of each group, as the built-in has it: null values do not count, and make null where alone."""
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.count(column).alias("_n"))
    large = _written(sizes.where(F.col("_n") > LIMIT))
    built_in = F.median(column).alias(column)
    if large.isEmpty():
        return rows.groupBy(*keys).agg(built_in)
    values = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("v"))
    inside = _written(_with_bounds(values, large, keys, []).groupBy(*keys, "v").agg(F.count("*").alias("n")))
    middle = F.call_function("div", F.col("_n") + 1, F.lit(2))
    state = large.select(*keys, middle.alias("first"), (F.call_function("div", F.col("_n"), F.lit(2)) + 1).alias("last"), F.lit(0).cast("bigint").alias("below"))
    done = None
    while not state.isEmpty():
        found = _narrowed(inside, state, keys)
        inside = _written(_with_bounds(inside, found, keys, ["_low", "_high"]).where(F.col("v").between(F.col("_low"), F.col("_high"))).drop("_low", "_high"))
        here = _picked(inside, found.where(F.col("distinct") <= LIMIT), keys)
        done = here if done is None else done.unionByName(here)
        state = found.where(F.col("distinct") > LIMIT).select(*keys, "first", "last", "below")
    result = done.withColumnRenamed("median", column)
    small = rows.join(large.select(*(F.col(c).alias(f"_key{k}") for k, c in enumerate(keys))), _equal(rows, keys), "left_anti").groupBy(*keys).agg(built_in)
    return small.withColumn(column, F.col(column).cast("double")).unionByName(result.select(*keys, column))


def _picked(inside: DataFrame, ready: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and median of groups that have few distinct values left: counts in order, and those that reach the ranks."""
    counts = _with_bounds(inside, ready, keys, ["first", "last", "below"])
    upto = F.col("below") + F.sum("n").over(W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumn("_upto", upto)
    at = lambda rank: F.min(F.when(F.col("_upto") >= F.col(rank), F.col("v")))
    return ranked.groupBy(*keys).agg(((at("first") + at("last")) / 2).alias("median"))
