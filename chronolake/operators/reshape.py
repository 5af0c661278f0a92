"""Between frames and cubes: flat, wide and long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cube import Cube, Layer, with_ordinals

LONG_KEYS = {"observation_id": "observation_id", "variable": "variable", "time": "time", "value": "value"}
#: The same keys by the names of the interface.
KEY_NAMES = {"observation_column": "observation_id", "variable_column": "variable", "time_column": "time", "value_column": "value"}
SUFFIX = "_t_"
#: Columns that a wide export may have.
WIDEST = 10_000


def _unpivoted(df: DataFrame, index: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form of columns; doubles if all are numbers or flags, else text. NaN becomes missing."""
    kinds = {f.name: f.dataType for f in df.schema}
    numeric = all(isinstance(kinds[c], T.NumericType | T.BooleanType) for c in columns)
    target = "double" if numeric else "string"
    cast = df.select(*index, *[F.col(f"`{c}`").cast(target).alias(c) for c in columns])
    out = cast.unpivot([F.col(c) for c in index], [F.col(f"`{c}`") for c in columns], "_variable", "value")
    return out.withColumn("value", F.when(F.isnan("value"), None).otherwise(F.col("value"))) if numeric else out


def _observations(df: DataFrame, index_column: str | int | None, obs_columns: Sequence[str]) -> DataFrame:
    """Rows in input order with obs_idx and obs_name."""
    rows = with_ordinals(df, "obs_idx")
    name = F.col("obs_idx")
    if index_column is not None:
        if isinstance(index_column, int):
            if index_column >= len(df.columns):
                raise IndexError("index_column is out of bounds")
            index_column = df.columns[index_column]
        if index_column not in df.columns:
            raise ValueError(f"index_column {index_column} is not a column")
        name = F.col(index_column)
    if missing := set(obs_columns) - set(df.columns):
        raise ValueError(f"columns_obs_only has unknown columns: {sorted(missing)}")
    return rows.withColumn("obs_name", name.cast("string"))


def _axis(df: DataFrame, column: str, index: str, name: str) -> DataFrame:
    """Sorted distinct values with ordinals; values sort by their own type, names are text."""
    values = df.select(F.col(column).alias("_v")).distinct()
    return with_ordinals(values, index, [F.col("_v")]).select(index, F.col("_v").cast("string").alias(name), "_v")


def _numbered(cells: DataFrame, var: DataFrame, tem: DataFrame | None) -> DataFrame:
    out = cells.join(var.select("var_idx", F.col("_v").alias("_variable")), "_variable")
    if tem is not None:
        out = out.join(tem.select("t_idx", F.col("_v").alias("_time")), "_time")
    return out.where("value IS NOT NULL").select("obs_idx", "var_idx", *["t_idx"] * (tem is not None), "value")


def from_frame(df: DataFrame, *, layer: str | None = None, format: str = "flat", columns_obs_only: Sequence[str] = (), index_column: str | int | None = None, wide_format_time_suffix: str | None = None, long_format_keys: dict | None = None, fill_time_gaps: bool = False) -> Cube:
    """A cube from a flat, wide or long frame."""
    if format not in ("flat", "wide", "long"):
        raise ValueError("format must be one of flat, wide, long")
    if fill_time_gaps and format != "long":
        raise ValueError("fill_time_gaps needs the long format")
    if long_format_keys is not None and format != "long":
        raise ValueError("long_format_keys needs the long format")
    if wide_format_time_suffix is not None and format != "wide":
        raise ValueError("wide_format_time_suffix needs the wide format")
    suffix = wide_format_time_suffix or SUFFIX
    name = layer or "X"
    if format == "long":
        if index_column is not None:
            raise ValueError("index_column cannot be used with the long format")
        return _from_long(df, name, columns_obs_only, long_format_keys, fill_time_gaps)
    obs = _observations(df, index_column, columns_obs_only)
    named = df.columns[index_column] if isinstance(index_column, int) else index_column
    columns = [c for c in df.columns if c not in columns_obs_only and c != named]
    attributes = obs.select("obs_idx", "obs_name", *columns_obs_only)
    cells = _unpivoted(obs, ["obs_idx"], columns)
    spark = df.sparkSession
    if format == "flat":
        var = spark.createDataFrame(list(enumerate(columns)), "var_idx int, var_name string").withColumn("_v", F.col("var_name"))
        return Cube.build(attributes, var.drop("_v"), None, {name: Layer(_numbered(cells, F.broadcast(var), None), 2)}, n_t=1)
    if bad := [c for c in columns if suffix not in c]:
        raise ValueError(f"columns without {suffix}: {bad}")
    pairs = [(c, *c.split(suffix)[:2]) for c in columns]
    axes = [sorted({p[k] for p in pairs}) for k in (1, 2)]  # text order: "10" before "2"
    place = spark.createDataFrame([(c, axes[0].index(v), axes[1].index(t)) for c, v, t in pairs], "_variable string, var_idx int, t_idx int")
    cells = cells.join(F.broadcast(place), "_variable").where("value IS NOT NULL").select("obs_idx", "var_idx", "t_idx", "value")
    var, tem = (spark.createDataFrame(list(enumerate(a)), f"{i} int, {n} string") for a, i, n in zip(axes, ("var_idx", "t_idx"), ("var_name", "tem_name"), strict=True))
    return Cube.build(attributes, var, tem, {name: Layer(cells, 3)}, n_t=len(axes[1]))


def _from_long(df: DataFrame, name: str, static: Sequence[str], keys: dict | None, fill_gaps: bool) -> Cube:
    keys = LONG_KEYS | {KEY_NAMES.get(k, k): v for k, v in (keys or {}).items()}
    if set(keys) != set(LONG_KEYS):
        raise ValueError(f"long_format_keys must be among {list(LONG_KEYS)}")
    rows = df.select(*[F.col(keys[k]).alias(a) for k, a in (("observation_id", "_obs"), ("variable", "_variable"), ("time", "_time"), ("value", "value"))])
    moving, fixed = rows.where(~F.col("_variable").isin(list(static))), rows.where(F.col("_variable").isin(list(static)))
    if not moving.groupBy("_obs", "_variable", "_time").count().where("count > 1").isEmpty():
        raise ValueError("an observation has several values of a variable at one time")
    obs, var = _axis(rows, "_obs", "obs_idx", "obs_name"), _axis(moving, "_variable", "var_idx", "var_name")
    if fill_gaps:
        last = int(moving.agg(F.max("_time")).first()[0])
        tem = df.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("t_idx"), F.col("id").cast("string").alias("tem_name"), F.col("id").alias("_v"))
    else:
        tem = _axis(moving, "_time", "t_idx", "tem_name")
    cells = _numbered(moving.join(obs.select("obs_idx", F.col("_v").alias("_obs")), "_obs"), var, tem)
    if static:
        wide = fixed.groupBy("_obs").pivot("_variable", list(static)).agg(F.first("value"))
        obs = obs.join(wide.withColumnRenamed("_obs", "_v"), "_v", "left")
    return Cube.build(obs.drop("_v"), var.drop("_v"), tem.drop("_v"), {name: Layer(cells, 3)})


def to_long(cube: Cube, layer: str = "X") -> DataFrame:
    """observation_id, variable, (time,) value of all cells, missing ones included.

    Names of variables and time steps, as many as the axes have, join by broadcast where they are few.
    """

    def few(df: DataFrame, n: int) -> DataFrame:
        return F.broadcast(df) if n <= 100_000 else df

    names = few(cube.obs.select("obs_idx", F.col("obs_name").alias("observation_id")), cube.n_obs)
    cells = cube.dense(layer).join(names, "obs_idx").join(few(cube.var.select("var_idx", F.col("var_name").alias("variable")), cube.n_vars), "var_idx")
    if cube.layers[layer].ndim == 2:
        return cells.select("observation_id", "variable", "value")
    cells = cells.join(few(cube.tem.select("t_idx", F.col("tem_name").alias("time")), cube.n_t), "t_idx")
    return cells.select("observation_id", "variable", "time", "value")


def to_wide(cube: Cube, layer: str = "X", obs_cols: Sequence[str] = (), var_col: str | None = None) -> DataFrame:
    """One row per observation; columns <variable>_t_<time>, variable by variable, or variables alone."""
    flat = cube.layers[layer].ndim == 2
    names = [(r["var_idx"], str(r[1])) for r in cube.var.orderBy("var_idx").select("var_idx", (var_col if flat and var_col else "var_name")).limit(WIDEST + 1).collect()]
    times = [None] if flat else [(r[0], r[1]) for r in cube.tem.orderBy("t_idx").select("t_idx", "tem_name").collect()]
    if len(names) * len(times) > WIDEST:
        raise ValueError(f"a wide frame has at most {WIDEST} columns")
    slots = [(f"{k}" if t is None else f"{k}:{t[0]}", v if t is None else f"{v}{SUFFIX}{t[1]}") for k, v in names for t in times]
    key = F.col("var_idx").cast("string") if flat else F.concat_ws(":", "var_idx", "t_idx")
    wide = cube.layers[layer].cells.withColumn("_slot", key).groupBy("obs_idx").pivot("_slot", [s for s, _ in slots]).agg(F.first("value"))
    out = cube.obs.select("obs_idx", "obs_name", *obs_cols).join(wide, "obs_idx", "left")
    return out.select("obs_name", *[F.col(f"`{s}`").alias(n) for s, n in slots], *obs_cols)


def to_frame(cube: Cube, *, layer: str = "X", format: str = "wide", obs_cols: Sequence[str] = (), var_col: str | None = None) -> DataFrame:
    if format == "long":
        if obs_cols:
            raise NotImplementedError("obs_cols are not supported in the long format")
        return to_long(cube, layer)
    if format != "wide":
        raise ValueError("format must be wide or long")
    return to_wide(cube, layer, obs_cols, var_col)


def from_pandas(spark, frame, **options) -> Cube:
    return from_frame(spark.createDataFrame(frame.reset_index(drop=True)), **options)


def to_pandas(cube: Cube, **options):
    return to_frame(cube, **options).toPandas()
