"""Exports: packed tensors with labels, and the flat slice of a time step."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spec import TIME_TABLES
from ..sources.catalog import Catalog
from .cube import Cube


def mortality(rows: DataFrame, start: str, end: str, death: str = "death_datetime"):
    """1 where the death lies between start and end, both included; 0 where it does not or is unknown."""
    return F.when(F.col(death).between(F.col(start), F.col(end)), 1).otherwise(0)


def packed(cube: Cube, layer: str = "X") -> DataFrame:
    """obs_idx and features: for each variable an array over time, NaN where missing; of a flat layer, one of one step."""
    fill = cube.layers[layer].fill
    number = lambda x: F.coalesce(x.cast("double"), F.lit(float("nan") if fill is None else float(fill)))
    line = (lambda v: F.transform(v, number)) if cube.layers[layer].ndim == 3 else (lambda v: F.array(number(v)))
    return cube.rows(layer).select("obs_idx", F.transform("rows", line).alias("features"))


def labelled_tensors(cube: Cube, catalog: Catalog, layer: str = "X", target: str = "mortality") -> DataFrame:
    """obs_idx, features and label; the only target is mortality within the observation."""
    if target != "mortality":
        raise NotImplementedError("the only target is mortality")
    spec = TIME_TABLES[cube.uns["observation_table"]]
    start, end = spec.start_datetime or spec.start_date, spec.end_datetime or spec.end_date
    obs = cube.obs.select("obs_idx", "person_id", F.col(start).cast("timestamp_ntz").alias("_a"), (F.col(end) if end else F.lit("2999-12-31 23:59:59")).cast("timestamp_ntz").alias("_b"))
    deaths = catalog["death"].groupBy("person_id").agg(F.max("death_datetime").cast("timestamp_ntz").alias("death_datetime"))
    labels = obs.join(deaths, "person_id", "left").select("obs_idx", mortality(obs, "_a", "_b").alias("label"))
    return packed(cube, layer).join(labels, "obs_idx")


def iterate(tensors: DataFrame) -> Iterator[tuple]:
    """(obs_idx, float32 array, label) one by one, partition by partition."""
    import numpy as np

    for r in tensors.orderBy("obs_idx").toLocalIterator():
        yield r["obs_idx"], np.array(r["features"], np.float32), r["label"]


def time_slice(cube: Cube, layer: str, timestep: int) -> Cube:
    """A flat cube of one time step; negative steps count from the end."""
    if not -cube.n_t <= timestep < cube.n_t:
        raise ValueError(f"timestep {timestep} is outside 0 to {cube.n_t - 1}")
    cells = cube.layers[layer].cells.where(F.col("t_idx") == timestep % cube.n_t).drop("t_idx")
    return Cube.build(cube.obs, cube.var, None, n_t=1).with_layer("X", cells, ndim=2)


def scatter_pair(cube: Cube, x: str, y: str) -> DataFrame:
    """Two columns of obs as a pair of coordinates: obs_idx and value."""
    return cube.obs.select("obs_idx", F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("value"))
