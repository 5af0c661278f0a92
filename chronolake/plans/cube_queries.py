"""Queries of cubes: slices, reshaping, reductions, moves, storage and export."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spec import DAY
from ..operators.binning import binned
from ..operators.cube import Cube, Layer, with_ordinals
from ..operators.export import packed, time_slice
from ..operators.move import move_to_obs, move_to_x
from ..operators.reshape import from_frame, to_long, to_wide
from ..sources.chunks import load_chunked, save_chunked
from ..sources.scratch import shared_dir
from ..sources.store import load, save, sparse
from ..sources.synthetic import blobs
from .roles import SQL_ROLES, measurements, sql_bins, table, users

STEPS = 10


def cube(spark: SparkSession, sf_dir: str, strategy: str = "max") -> Cube:
    """Users x event types x days of the largest value; names are the ids and types."""
    obs, events = users(spark, sf_dir), measurements(spark, sf_dir)
    cells = binned(obs, events, length=DAY, count=STEPS, fields=["value"], strategy=strategy, order=["event_id"])
    rows = with_ordinals(obs.select("obs_id"), "obs_idx", [F.col("obs_id")]).withColumn("obs_name", F.col("obs_id").cast("string")).withColumn("parity", F.col("obs_id") % 2)
    var = with_ordinals(events.select("concept").distinct(), "var_idx", [F.col("concept")]).withColumn("var_name", F.col("concept"))
    layer = cells.join(rows.select("obs_id", "obs_idx"), "obs_id").join(var.select("concept", "var_idx"), "concept")
    layer = layer.where("value IS NOT NULL").select("obs_idx", "var_idx", F.col("interval_step").alias("t_idx"), "value")
    return Cube.build(rows, var.drop("concept"), None, {"X": Layer(layer, 3)}, n_t=STEPS)


def named(c: Cube, layer: str = "X") -> DataFrame:
    """Cells that have a value, by names."""
    out = c.layers[layer].cells.join(c.obs.select("obs_idx", "obs_name"), "obs_idx").join(c.var.select("var_idx", "var_name"), "var_idx")
    return out.select("obs_name", "var_name", "obs_idx", *["t_idx"] * (c.layers[layer].ndim == 3), "value")


def slice_obs(spark, sf_dir):
    return named(cube(spark, sf_dir)[10:60:5])


def slice_var(spark, sf_dir):
    return named(cube(spark, sf_dir)[:, ["purchase", "view"]])


def slice_time(spark, sf_dir):
    return named(cube(spark, sf_dir)[:, :, -3:])


def outer_product(spark, sf_dir):
    """Lists on all axes, then a slice of the slice, then a condition on a column."""
    return named(cube(spark, sf_dir)[[3, 1, 7, 11, 14], ["click", "error", "view"], [0, 2, 5]][1:5, :2].sel(obs=F.col("parity") == 1))


def reduced(how: str):
    def query(spark, sf_dir):
        return named(cube(spark, sf_dir).reduce_time("X", how, to="R"), "R").select("obs_name", "var_name", F.round("value", 6).alias("value"))

    return query


def dense_backbone(spark, sf_dir):
    return to_long(cube(spark, sf_dir)).select(F.col("observation_id").alias("obs"), F.col("variable").alias("var"), F.col("time").alias("step"), "value")


def long_to_wide(spark, sf_dir):
    wide = to_wide(cube(spark, sf_dir)[:, ["click", "view"], :3])
    return wide.toDF("obs", *[c.replace("_t_", "_") for c in wide.columns[1:]])


def long_to_wide_all(spark, sf_dir):
    """All variables and days in columns."""
    wide = to_wide(cube(spark, sf_dir))
    return wide.toDF("obs", *[c.replace("_t_", "_") for c in wide.columns[1:]])


def wide_to_long_all(spark, sf_dir):
    """A wide export of all variables and days read back as a cube."""
    back = from_frame(to_wide(cube(spark, sf_dir)), format="wide", index_column="obs_name")
    return named(back).select(F.col("obs_name").alias("obs"), F.col("var_name").alias("var"), "t_idx", "value")


def wide_to_long(spark, sf_dir):
    """A wide export read back as a cube."""
    wide = to_wide(cube(spark, sf_dir)[:, :, :3])
    back = from_frame(wide, format="wide", index_column="obs_name")
    return named(back).select(F.col("obs_name").alias("obs"), F.col("var_name").alias("var"), "t_idx", "value")


def flat_to_long(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"), "p_retailprice")
    return named(from_frame(part, index_column="p_partkey")).select(F.col("obs_name").alias("part"), F.col("var_name").alias("var"), "value")


def fill_time_gaps(spark, sf_dir):
    """Day numbers with gaps become the whole axis from 0 to the last day."""
    rows = measurements(spark, sf_dir).select(F.col("person_id").alias("observation_id"), F.col("concept").alias("variable"), (F.dayofmonth("at").cast("long")).alias("time"), F.col("value"), "event_id")
    rows = rows.where("time % 3 = 0").groupBy("observation_id", "variable", "time").agg(F.max("value").alias("value"))
    c = from_frame(rows, format="long", fill_time_gaps=True)
    return c.tem.join(c.layers["X"].cells.groupBy("t_idx").count(), "t_idx", "left").select("tem_name", F.coalesce("count", F.lit(0)).alias("n"))


def fill_time_gaps_all(spark, sf_dir):
    """All rows at three times their day number, so that two of three steps are gaps."""
    rows = measurements(spark, sf_dir).select(F.col("person_id").alias("observation_id"), F.col("concept").alias("variable"), (3 * F.dayofmonth("at").cast("long")).alias("time"), F.col("value"))
    rows = rows.groupBy("observation_id", "variable", "time").agg(F.max("value").alias("value"))
    c = from_frame(rows, format="long", fill_time_gaps=True)
    return c.tem.join(c.layers["X"].cells.groupBy("t_idx").count(), "t_idx", "left").select("tem_name", F.coalesce("count", F.lit(0)).alias("n"))


def moved_to_obs(spark, sf_dir):
    c = move_to_obs(time_slice(cube(spark, sf_dir), "X", 0), ["click", "view"])
    return c.obs.join(c.X.cells.groupBy("obs_idx").agg(F.count("*").alias("left_over")), "obs_idx", "left").select("obs_name", "click", "view", F.coalesce("left_over", F.lit(0)).alias("left_over"))


def moved_to_x(spark, sf_dir):
    c = move_to_x(time_slice(cube(spark, sf_dir), "X", 1), "parity")
    return named(c).select("obs_name", "var_name", "value")


def stored(spark, sf_dir):
    """A cube written and read back."""
    return named(load(spark, _saved(cube(spark, sf_dir))))


def chunked(spark, sf_dir):
    """A cube written as chunked arrays and read back."""
    return named(load_chunked(spark, _chunks(cube(spark, sf_dir))))


def chunked_slice(spark, sf_dir):
    """Every fifth user from the eleventh on, in the last days, of chunked arrays: the filters choose the chunks."""
    return named(load_chunked(spark, _chunks(cube(spark, sf_dir), (32, 2, 4)))[10::5, :, 7:])


def _chunks(c: Cube, chunks="auto") -> str:
    path = f"{shared_dir(c.obs.sparkSession)}/chunks-{uuid.uuid4().hex}"
    save_chunked(c, path, chunks=chunks)
    return path


def _saved(c: Cube) -> str:
    path = f"{shared_dir(c.obs.sparkSession)}/cube-{uuid.uuid4().hex}"
    save(c, path)
    return path


def stored_sparse(spark, sf_dir):
    """A layer of counts without its zeros, written, read back and made dense again."""
    c = cube(spark, sf_dir, "count")
    layer = replace(c.X, cells=sparse(c.X.cells, 0), fill=0)
    back = load(spark, _saved(replace(c, layers={"X": layer})))
    return back.dense("X").select(F.col("obs_idx").cast("long").alias("obs"), F.col("var_idx").cast("long").alias("var"), F.col("t_idx").cast("long").alias("step"), F.col("value").cast("long").alias("value"))


def slice_mask(spark, sf_dir):
    """Flags on all axes, as an array, a list and a series."""
    import numpy as np
    import pandas as pd

    c = cube(spark, sf_dir)
    return named(c[np.arange(c.n_obs) % 4 == 1, [True, False, True, False, True], pd.Series(range(STEPS)) < 7])


def slice_label(spark, sf_dir):
    """Labels from one to another, both included, and every second step backwards."""
    return named(cube(spark, sf_dir)[:, "error":"signup", ::-2])


def tensors(spark, sf_dir):
    """One packed array per observation, unpacked again for comparison."""
    rows = packed(cube(spark, sf_dir)).select("obs_idx", F.posexplode("features").alias("var_idx", "line"))
    return rows.select("obs_idx", "var_idx", F.posexplode("line").alias("t_idx", "value")).where("NOT isnan(value)")


def generated(spark, sf_dir):
    """Records of all users, each from the hour of its first event on and as long as it has events: the united axis, and the records and cells of each time."""
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("_first"), F.count("*").alias("_n"))
    hours = F.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("_first").cast("timestamp_ntz"))
    records = events.select(F.col("user_id").cast("string").alias("obs_name"), hours.cast("double").alias("start"), F.least("_n", F.lit(9)).cast("int").alias("steps"))
    c = blobs(spark, records=records, n_variables=4, n_categorical=1)
    cells = c.layers["tem_data"].cells
    per = cells.groupBy("t_idx").agg(F.count_distinct("obs_idx").alias("n_records"), F.count("*").alias("n_cells"), F.count_if(F.abs("value") < 200).alias("n_bounded"))
    return c.tem.join(per, "t_idx").select(F.col("timepoint").cast("long").alias("timepoint"), F.round("time_value", 6).alias("time_value"), "n_records", "n_cells", "n_bounded")


QUERIES = {
    "slice_obs": slice_obs, "slice_var": slice_var, "slice_time": slice_time, "slice_outer_product": outer_product,
    "reduce_time_max": reduced("max"), "reduce_time_min": reduced("min"), "reduce_time_mean": reduced("mean"), "dense_backbone": dense_backbone,
    "long_to_wide": long_to_wide, "wide_to_long": wide_to_long, "long_to_wide_all": long_to_wide_all, "wide_to_long_all": wide_to_long_all, "fill_time_gaps_all": fill_time_gaps_all, "flat_to_long": flat_to_long, "fill_time_gaps": fill_time_gaps,
    "move_to_obs": moved_to_obs, "move_to_x": moved_to_x, "store_round_trip": stored, "tensor_export": tensors, "generator": generated,
    "store_chunks": chunked, "store_chunks_slice": chunked_slice, "slice_mask": slice_mask, "slice_label": slice_label, "store_sparse": stored_sparse,
}

_CUBE = f"""WITH {SQL_ROLES}, {sql_bins(STEPS, "1 day")},
cells AS (
  SELECT CAST(x.obs_id AS VARCHAR) AS obs_name, x.concept AS var_name, CAST(x.obs_index AS INTEGER) AS obs_idx, x.interval_step AS t_idx, MAX(m.value) AS value
  FROM (SELECT *, dense_rank() OVER (ORDER BY obs_id) - 1 AS obs_index FROM bins) x
  JOIN measurements m ON x.person_id = m.person_id AND x.concept = m.concept AND m.ts >= x.a AND m.ts < x.b
  GROUP BY ALL HAVING MAX(m.value) IS NOT NULL)"""
SQL = {
    "slice_obs": f"{_CUBE} SELECT obs_name, var_name, CAST((obs_idx - 10) / 5 AS INTEGER) AS obs_idx, t_idx, value FROM cells WHERE obs_idx BETWEEN 10 AND 59 AND obs_idx % 5 = 0",
    "slice_var": f"{_CUBE} SELECT * FROM cells WHERE var_name IN ('purchase', 'view')",
    "slice_time": f"{_CUBE} SELECT obs_name, var_name, obs_idx, CAST(t_idx - 7 AS INTEGER) AS t_idx, value FROM cells WHERE t_idx >= 7",
    "slice_outer_product": f"""{_CUBE}, picked AS (SELECT *, CASE obs_idx WHEN 1 THEN 0 WHEN 7 THEN 1 WHEN 11 THEN 2 END AS o, CASE t_idx WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS t FROM cells)
SELECT obs_name, var_name, CAST(o AS INTEGER) AS obs_idx, CAST(t AS INTEGER) AS t_idx, value FROM picked WHERE obs_idx IN (1, 7, 11) AND var_name IN ('click', 'error') AND t_idx IN (0, 2, 5)""",
    "reduce_time_max": f"{_CUBE} SELECT obs_name, var_name, max(value) AS value FROM cells GROUP BY ALL",
    "reduce_time_min": f"{_CUBE} SELECT obs_name, var_name, min(value) AS value FROM cells GROUP BY ALL",
    "reduce_time_mean": f"{_CUBE} SELECT obs_name, var_name, round(avg(value), 6) AS value FROM cells GROUP BY ALL",
    "dense_backbone": f"""{_CUBE} SELECT CAST(x.obs_id AS VARCHAR) AS obs, x.concept AS var, CAST(x.interval_step AS VARCHAR) AS step, c.value
FROM bins x LEFT JOIN cells c ON c.obs_name = CAST(x.obs_id AS VARCHAR) AND c.var_name = x.concept AND c.t_idx = x.interval_step""",
    "long_to_wide": f"""{_CUBE} SELECT CAST(u.obs_id AS VARCHAR) AS obs, {", ".join(f"max(value) FILTER (var_name = '{v}' AND t_idx = {t}) AS {v}_{t}" for v in ("click", "view") for t in range(3))}
FROM users u LEFT JOIN cells c ON c.obs_name = CAST(u.obs_id AS VARCHAR) GROUP BY u.obs_id""",
    "wide_to_long": f"{_CUBE} SELECT obs_name AS obs, var_name AS var, t_idx, value FROM cells WHERE t_idx < 3",
    "long_to_wide_all": f"""{_CUBE} SELECT CAST(u.obs_id AS VARCHAR) AS obs, {", ".join(f"max(value) FILTER (var_name = '{v}' AND t_idx = {t}) AS {v}_{t}" for v in ("click", "error", "purchase", "signup", "view") for t in range(STEPS))}
FROM users u LEFT JOIN cells c ON c.obs_name = CAST(u.obs_id AS VARCHAR) GROUP BY u.obs_id""",
    "wide_to_long_all": f"{_CUBE} SELECT obs_name AS obs, var_name AS var, t_idx, value FROM cells",
    "fill_time_gaps_all": f"""WITH {SQL_ROLES}, d AS (SELECT person_id, concept, 3 * CAST(day(ts) AS BIGINT) AS t, max(value) AS v FROM measurements GROUP BY ALL)
SELECT CAST(i AS VARCHAR) AS tem_name, (SELECT count(v) FROM d WHERE t = i) AS n FROM (SELECT unnest(range((SELECT max(t) + 1 FROM d))) AS i)""",
    "flat_to_long": "SELECT CAST(p_partkey AS VARCHAR) AS part, 'size' AS var, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'p_retailprice', p_retailprice FROM part",
    "fill_time_gaps": f"""WITH {SQL_ROLES}, d AS (SELECT person_id, concept, CAST(day(ts) AS BIGINT) AS t, max(value) AS v FROM measurements WHERE day(ts) % 3 = 0 GROUP BY ALL)
SELECT CAST(i AS VARCHAR) AS tem_name, (SELECT count(v) FROM d WHERE t = i) AS n FROM (SELECT unnest(range((SELECT max(t) + 1 FROM d))) AS i)""",
    "move_to_obs": f"""{_CUBE} SELECT CAST(u.obs_id AS VARCHAR) AS obs_name, max(value) FILTER (var_name = 'click' AND t_idx = 0) AS click,
  max(value) FILTER (var_name = 'view' AND t_idx = 0) AS view, count(value) FILTER (var_name NOT IN ('click', 'view') AND t_idx = 0) AS left_over
FROM users u LEFT JOIN cells c ON c.obs_name = CAST(u.obs_id AS VARCHAR) GROUP BY u.obs_id""",
    "move_to_x": f"{_CUBE} SELECT obs_name, var_name, value FROM cells WHERE t_idx = 1 UNION ALL SELECT CAST(obs_id AS VARCHAR), 'parity', CAST(obs_id % 2 AS DOUBLE) FROM users",
    "slice_mask": f"{_CUBE} SELECT obs_name, var_name, CAST((obs_idx - 1) / 4 AS INTEGER) AS obs_idx, t_idx, value FROM cells WHERE obs_idx % 4 = 1 AND var_name IN ('click', 'purchase', 'view') AND t_idx < 7",
    "slice_label": f"{_CUBE} SELECT obs_name, var_name, obs_idx, CAST((9 - t_idx) / 2 AS INTEGER) AS t_idx, value FROM cells WHERE var_name BETWEEN 'error' AND 'signup' AND t_idx % 2 = 1",
    "store_sparse": f"""WITH {SQL_ROLES}, {sql_bins(STEPS, "1 day")} SELECT dense_rank() OVER (ORDER BY x.obs_id) - 1 AS obs, dense_rank() OVER (ORDER BY x.concept) - 1 AS var, CAST(x.interval_step AS BIGINT) AS step, count(m.value) AS value
FROM bins x LEFT JOIN measurements m ON x.person_id = m.person_id AND x.concept = m.concept AND m.ts >= x.a AND m.ts < x.b GROUP BY x.obs_id, x.concept, x.interval_step""",
    "generator": """WITH records AS (SELECT user_id, CAST(date_diff('microsecond', TIMESTAMP '2024-01-01', min(ts)) // 3600000000 AS DOUBLE) AS start, least(count(*), 9) AS steps FROM events GROUP BY user_id),
longest AS (SELECT CAST(max(steps) AS DOUBLE) AS n FROM records), each AS (SELECT user_id, start, steps, unnest(range(steps)) AS k FROM records),
times AS (SELECT user_id, start + CASE WHEN steps > 1 THEN k * n / (steps - 1) ELSE 0 END AS t FROM each, longest)
SELECT row_number() OVER (ORDER BY t) - 1 AS timepoint, round(t, 6) AS time_value, count(*) AS n_records, 4 * count(*) AS n_cells, 4 * count(*) AS n_bounded FROM times GROUP BY t""",
    "store_round_trip": f"{_CUBE} SELECT * FROM cells",
    "store_chunks": f"{_CUBE} SELECT * FROM cells",
    "store_chunks_slice": f"{_CUBE} SELECT obs_name, var_name, CAST((obs_idx - 10) / 5 AS INTEGER) AS obs_idx, CAST(t_idx - 7 AS INTEGER) AS t_idx, value FROM cells WHERE t_idx >= 7 AND obs_idx >= 10 AND obs_idx % 5 = 0",
    "tensor_export": f"{_CUBE} SELECT obs_idx, CAST(v.i AS INTEGER) AS var_idx, t_idx, value FROM cells JOIN (SELECT concept, dense_rank() OVER (ORDER BY concept) - 1 AS i FROM concepts) v ON v.concept = var_name",
}
