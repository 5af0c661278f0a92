"""Moving columns between the observations and the variables of flat cubes."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import functions as F

from .cube import Cube
from .reshape import _unpivoted

log = logging.getLogger(__name__)


def move_to_obs(cube: Cube, var_names: str | Sequence[str], *, layer: str = "X", copy_columns: bool = False) -> Cube:
    """Variables as columns of obs; without copy_columns they leave var and all layers."""
    names = [var_names] if isinstance(var_names, str) else list(var_names)
    if cube.layers[layer].ndim != 2:
        raise ValueError("only a layer of two axes can be moved to obs")
    place = {r["var_name"]: r["var_idx"] for r in cube.var.where(F.col("var_name").isin(names)).select("var_idx", "var_name").collect()}
    if missing := set(names) - set(place):
        raise ValueError(f"not among the variables: {sorted(missing)}")
    ids = [place[n] for n in names]
    wide = cube.layers[layer].cells.where(F.col("var_idx").isin(ids)).groupBy("obs_idx").pivot("var_idx", ids).agg(F.first("value"))
    obs = cube.obs.join(wide.toDF("obs_idx", *names), "obs_idx", "left")
    out = replace(cube, obs=obs)
    return out if copy_columns else replace(out.sel(var=~F.col("var_name").isin(names)), is_view=False)


def move_to_x(cube: Cube, features: str | Sequence[str], *, layer: str = "X", copy_columns: bool = False) -> Cube:
    """Columns of obs as variables of a layer; the result keeps this layer, obs and var."""
    names = [features] if isinstance(features, str) else list(features)
    deep = cube.layers[layer].ndim == 3
    if deep and cube.n_t > 1:
        raise ValueError("only a layer of two axes can take columns of obs")
    known = {r[0] for r in cube.var.select("var_name").where(F.col("var_name").isin(names)).collect()}
    if known:
        log.warning("already among the variables, skipped: %s", sorted(known))
    new = [n for n in names if n not in known]
    if missing := [n for n in new if n not in cube.obs.columns]:
        raise ValueError(f"not among the columns of obs: {missing}")
    if not new:
        return cube
    cells = cube.layers[layer].cells
    more = _unpivoted(cube.obs, ["obs_idx"], new)
    at = F.create_map(*[x for k, n in enumerate(new) for x in (F.lit(n), F.lit(cube.n_vars + k))])
    more = more.select("obs_idx", F.element_at(at, F.col("_variable")).alias("var_idx"), *[F.lit(0).alias("t_idx")] * deep, "value").where("value IS NOT NULL")
    if dict(cells.dtypes)["value"] != dict(more.dtypes)["value"]:
        cells, more = (d.withColumn("value", F.col("value").cast("string")) for d in (cells, more))
    spark = cube.obs.sparkSession
    added = spark.createDataFrame([(cube.n_vars + k, n) for k, n in enumerate(new)], "var_idx int, var_name string")
    var = cube.var.unionByName(added, allowMissingColumns=True)
    obs = cube.obs if copy_columns else cube.obs.drop(*new)
    kept = replace(cube.layers[layer], cells=cells.unionByName(more))
    return Cube(obs, var, cube.tem, {layer: kept}, cube.n_obs, cube.n_vars + len(new), cube.n_t)
