"""A generator of clustered longitudinal records with real times of their own, row by row from hashes of a seed.

Each record has its own times; the time axis of the cube is the union of all of them, made by a distinct, a range sort
and ordinals, to which the samples are joined back.  So records of regular, shifted or irregular times meet on one axis, which keeps
the times as time_value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.cube import Cube, Layer, pinned, with_ordinals

#: Times of an axis that are broadcast to the samples, at most; a longer axis is joined by a shuffle.
FEW = 1_000_000
PI = 3.141592653589793


def _uniform(seed: int, *columns):
    """A number in (0, 1) that depends on the seed and the columns alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(2**52)).cast("double") + 0.5) / float(2**52)


def _normal(seed: int, *columns):
    return F.sqrt(-2 * F.log(_uniform(seed, *columns))) * F.cos(2 * PI * _uniform(seed + 1, *columns))


def sample_times(records: DataFrame, *, irregular: bool = False, seed: int = 0) -> DataFrame:
    """obs_idx, k and time_value: the times of each record (obs_idx, start, steps).

    Regular times go from the start on in equal steps over the length of the longest record; irregular ones have exponential
    distances that add up to what the start leaves of it.
    """
    longest = float(records.agg(F.max("steps")).first()[0] or 0)
    each = records.where("steps > 0").select("obs_idx", "start", "steps", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("k"))
    if irregular:
        step = each.withColumn("_step", -F.log(_uniform(seed + 100, "obs_idx", "k")))
        # a record's own times are few
        own = W.partitionBy("obs_idx")
        upto = F.sum("_step").over(own.orderBy("k").rowsBetween(W.unboundedPreceding, 0)) / F.sum("_step").over(own)
        return step.select("obs_idx", "k", (F.col("start") + upto * (F.lit(longest) - F.col("start"))).alias("time_value"))
    part = F.when(F.col("steps") > 1, F.col("k") * F.lit(longest) / (F.col("steps") - 1)).otherwise(0.0)
    return each.select("obs_idx", "k", (F.col("start") + part).alias("time_value"))


def united(times: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The union of all records' times as a time axis, the samples with their places on it, and its length."""
    axis = with_ordinals(times.select("time_value").distinct(), "t_idx", [F.col("time_value")])
    n_t = axis.count()
    tem = axis.select("t_idx", F.col("t_idx").cast("string").alias("tem_name"), F.col("t_idx").alias("timepoint"), "time_value")
    place = axis.select("t_idx", F.col("time_value").alias("_time"))
    placed = times.join(F.broadcast(place) if n_t <= FEW else place, F.col("time_value") == F.col("_time")).drop("_time")
    return tem, placed, n_t


def _records(spark: SparkSession, given: DataFrame | None, n: int, n_timepoints: int, n_centers: int, variable_length: bool, time_shifts: bool, seed: int) -> DataFrame:
    """obs_idx, obs_name, cluster, start and steps of each record; those of given records where it has them."""
    if given is None:
        out = spark.range(n).select(F.col("id").cast("int").alias("obs_idx")).withColumn("obs_name", F.col("obs_idx").cast("string"))
    else:
        out = with_ordinals(given.select(*(c for c in given.columns if c in ("obs_name", "start", "steps"))), "obs_idx", [F.col("obs_name")])
    if "steps" not in out.columns:
        spread = F.greatest(F.lit(10), F.floor((0.5 + _uniform(seed + 10, "obs_idx")) * n_timepoints)) if variable_length else F.lit(n_timepoints)
        out = out.withColumn("steps", spread.cast("int"))
    if "start" not in out.columns:
        out = out.withColumn("start", 0.3 * n_timepoints * _uniform(seed + 20, "obs_idx") if time_shifts else F.lit(0.0))
    return out.withColumn("cluster", F.floor(_uniform(seed, "obs_idx") * n_centers).cast("int"))


def _value(seed: int, n_centers: int, std: float, seasonality: bool, n_t: int) -> Column:
    """A base by cluster and record, a trend to one and a half of it, seasons as large as a third, noise that grows along the axis."""
    base = 5 * _normal(seed + 30, "cluster", "var_idx") + std * _normal(seed + 40, "obs_idx", "var_idx")
    share = F.col("k") / F.greatest(F.col("steps") - 1, F.lit(1))
    waves = 3 + 12 * _uniform(seed + 50, "obs_idx", "var_idx")
    season = 0.3 * F.abs(base) * F.sin(waves * PI * F.col("k") / F.col("steps") + F.col("cluster") * PI / n_centers) if seasonality else F.lit(0.0)
    noise = std / 2 * (0.5 + F.col("t_idx") / max(n_t, 1)) * _normal(seed + 60, "obs_idx", "var_idx", "k")
    return base * (1 + share / 2) + season + noise


def blobs(spark: SparkSession, *, n_observations: int = 1000, n_variables: int = 11, n_timepoints: int = 100, n_centers: int = 5, n_categorical: int = 0, n_categories: int | list[int] = 3, cluster_std: float = 1.0, time_shifts: bool = False, variable_length: bool = False, seasonality: bool = True, irregular: bool = False, sparsity: float | None = None, missing: float = 0.0, seed: int = 0, layer: str = "tem_data", records: DataFrame | None = None) -> Cube:
    """Clusters around N(0, 5) centers, on the union of the records' time axes.

    With variable_length records have 50 to 150 % of n_timepoints (10 at least), with time_shifts they begin up to 30 % of it later,
    with irregular their distances in time are exponential.  records gives the observations instead: obs_name and,
    where it has them, start (double) and steps (int).  The last n_categorical variables are categories that lean to
    the cluster, n_categories of them or as many as its list says for each.  With sparsity, that share of
    the cells is 0, which is the layer's fill and not stored.
    """
    kinds = n_categories if isinstance(n_categories, list) else [n_categories] * n_categorical
    if n_categorical > n_variables:
        raise ValueError("there are fewer variables than categorical ones")
    if len(kinds) != n_categorical:
        raise ValueError("n_categories must be a number or have one for each categorical variable")
    obs = _records(spark, records, n_observations, n_timepoints, n_centers, variable_length, time_shifts, seed)
    tem, placed, n_t = united(pinned(sample_times(obs, irregular=irregular, seed=seed)))
    cells = placed.join(obs.select("obs_idx", "cluster", "steps"), "obs_idx").withColumn("var_idx", F.explode(F.sequence(F.lit(0), F.lit(n_variables - 1))))
    value = _value(seed, n_centers, cluster_std, seasonality, n_t)
    if n_categorical:
        many = F.get(F.array(*map(F.lit, kinds)), F.col("var_idx") - (n_variables - n_categorical))
        own, other = F.col("cluster") % many, F.floor(_uniform(seed + 70, "obs_idx", "var_idx", "k") * (many - 1))
        other = F.when(other >= own, other + 1).otherwise(other)  # the other ones, equally often
        stays = (_uniform(seed + 80, "obs_idx", "var_idx", "k") < 1 / (1 + cluster_std)) | (many == 1)
        value = F.when(F.col("var_idx") >= n_variables - n_categorical, F.when(stays, own).otherwise(other).cast("double")).otherwise(value)
    cells = cells.withColumn("value", value)
    if missing:
        cells = cells.where(_uniform(seed + 90, "obs_idx", "var_idx", "k") >= missing)
    if sparsity is not None:
        cells = cells.where((_uniform(seed + 110, "obs_idx", "var_idx", "k") >= sparsity) & (F.col("value") != 0))
    var = spark.range(n_variables).select(F.col("id").cast("int").alias("var_idx"), F.concat(F.lit("feature_"), "id").alias("var_name"))
    stored = Layer(cells.select("obs_idx", "var_idx", "t_idx", "value"), 3, None if sparsity is None else 0.0)
    return Cube.build(obs.select("obs_idx", "obs_name", "cluster"), var, tem, {layer: stored}, n_t=n_t)
