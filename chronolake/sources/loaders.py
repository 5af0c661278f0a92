"""Loaders of challenge data sets and flat tables from local or shared paths; nothing is downloaded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bins import closed_step
from ..operators.cube import Cube, Layer, with_ordinals
from ..operators.reshape import from_frame
from .catalog import Catalog, setup_connection
from .sniff import read_sniffed
from .store import load

#: Static parameters of the two challenges.
STATIC_2012 = ("Age", "Gender", "ICUType", "Height")
STATIC_2019 = ("Age", "Gender", "Unit1", "Unit2", "HospAdmTime")


def read_csv(spark: SparkSession, filename: str, *, sep: str | None = None, **options) -> Cube:
    """A CSV file as a cube; its dialect is found, but for a given separator, and options are those of from_frame."""
    return from_frame(read_sniffed(spark, filename, sep=sep), **options)


def clock_hours(text: Column) -> Column:
    """Hours of "HH:MM"."""
    parts = F.split(text, ":")
    return parts[0].cast("double") + parts[1].cast("double") / 60


def binned_long(rows: DataFrame, *, length: float, count: int, keep: str = "last") -> DataFrame:
    """Rows (record, parameter, hours, value, position) in right-closed bins; one row of each bin stays.

    Later rows than the last bin's end are dropped; ``keep`` takes the first or last by position.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be first or last")
    pick = F.max_by if keep == "last" else F.min_by
    inside = rows.where(F.col("hours") <= length * count).withColumn("step", closed_step(F.col("hours"), length))
    return inside.groupBy("record", "parameter", "step").agg(pick("value", "position").alias("value"))


def challenge_cube(rows: DataFrame, obs: DataFrame, parameters: Sequence[str], *, length: float = 1.0, count: int = 48, unit: str = "h", keep: str = "last", drop: Sequence[str] = (), layer: str = "tem_data", null_if: dict[str, float] | None = None) -> Cube:
    """A cube of all observations, the expected parameters and all steps.

    null_if names parameters whose given value means missing.
    """
    spark = rows.sparkSession
    obs = obs.where(~F.col("record").isin(list(drop))) if drop else obs
    obs = with_ordinals(obs, "obs_idx", [F.col("record")]).withColumn("obs_name", F.col("record").cast("string"))
    var = spark.createDataFrame(list(enumerate(parameters)), "var_idx int, var_name string")
    for name, value in (null_if or {}).items():
        rows = rows.withColumn("value", F.when((F.col("parameter") == name) & (F.col("value") == value), None).otherwise(F.col("value")))
    cells = binned_long(rows, length=length, count=count, keep=keep).join(obs.select("record", "obs_idx"), "record")
    cells = cells.join(F.broadcast(var.withColumnRenamed("var_name", "parameter")), "parameter")
    cells = cells.where("value IS NOT NULL").select("obs_idx", "var_idx", F.col("step").alias("t_idx"), "value")
    starts = [(k, str(k), f"{k * length:g}{unit}", f"{(k + 1) * length:g}{unit}") for k in range(count)]
    tem = spark.createDataFrame(starts, "t_idx int, tem_name string, interval_start_offset string, interval_end_offset string")
    return Cube.build(obs, var, tem, {layer: Layer(cells, 3)}, n_t=count)


def physionet2012(spark: SparkSession, paths: str | list[str], outcomes: str | None = None, *, static: Sequence[str] = STATIC_2012, **options) -> Cube:
    """Files of one record each (Time, Parameter, Value); the first row of a file is its id."""
    text = spark.read.csv(paths, header=True, schema="Time string, Parameter string, Value double").withColumn("_file", F.input_file_name()).withColumn("position", F.monotonically_increasing_id())
    rows = text.where(F.col("Parameter") != "RecordID").select(F.regexp_extract("_file", r"([^/]+)\.[^./]*$", 1).alias("record"), F.col("Parameter").alias("parameter"), clock_hours(F.col("Time")).alias("hours"), F.col("Value").alias("value"), "position")
    fixed = rows.where(F.col("parameter").isin(list(static))).groupBy("record").pivot("parameter", list(static)).agg(F.max_by("value", -F.col("position")))
    if outcomes:
        found = spark.read.csv(outcomes, header=True, inferSchema=True).withColumn("record", F.col("RecordID").cast("string"))
        fixed = fixed.join(found.drop("RecordID"), "record", "left")
    moving = rows.where(~F.col("parameter").isin(list(static)))
    names = options.pop("parameters", None) or [r[0] for r in moving.select("parameter").distinct().orderBy("parameter").collect()]
    return challenge_cube(moving, fixed, names, **options)


def physionet2019(spark: SparkSession, paths: str | list[str], *, n_samples: int | None = None, seed: int = 0, static: Sequence[str] = STATIC_2019, **options) -> Cube:
    """Pipe-separated files of one record each, a row per hour; statics come from the first row."""
    wide = spark.read.csv(paths, header=True, inferSchema=True, sep="|").withColumn("record", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1))
    if n_samples is not None:
        records = wide.select("record").distinct()
        if n_samples > records.count():
            raise ValueError("n_samples is larger than the number of records")
        wide = wide.join(records.orderBy(F.xxhash64("record", F.lit(seed)), "record").limit(n_samples), "record", "left_semi")
    parameters = options.pop("parameters", None) or [c for c in wide.columns if c not in (*static, "ICULOS", "record")]
    first = wide.groupBy("record").agg(*[F.min_by(c, "ICULOS").alias(c) for c in static if c in wide.columns])
    long = wide.select("record", F.col("ICULOS").cast("double").alias("hours"), *[F.col(c).cast("double").alias(c) for c in parameters])
    long = long.unpivot(["record", "hours"], parameters, "parameter", "value").where("value IS NOT NULL AND NOT isnan(value)").withColumn("position", F.col("hours"))
    return challenge_cube(long, first, parameters, **options)


def recoded_flag(value: Column) -> Column:
    """0 becomes 1 and everything else 0: a censoring flag as an event flag."""
    return F.when(value == 0, 1).otherwise(0)


def flat_set(spark: SparkSession, path: str, columns_obs_only: Sequence[str] = (), **options) -> Cube:
    """A flat data set of one CSV file with a header, such as diabetes_130_raw and diabetes_130_fairlearn."""
    return read_csv(spark, path, columns_obs_only=columns_obs_only, **options)


diabetes_130_raw = diabetes_130_fairlearn = flat_set


def mimic_2(spark: SparkSession, path: str, columns_obs_only: Sequence[str] = ()) -> Cube:
    """The cohort file; its flag censor_flg, 0 for an event, is turned wherever it lies."""
    frame = spark.read.csv(path, header=True, inferSchema=True)
    if "censor_flg" in frame.columns:
        frame = frame.withColumn("censor_flg", recoded_flag(F.col("censor_flg")))
    return from_frame(frame, columns_obs_only=columns_obs_only)


def mimic_2_preprocessed(spark: SparkSession, path: str) -> Cube:
    """The preprocessed cohort, as a stored cube or, by its ending, a CSV file."""
    return read_csv(spark, path) if path.endswith(".csv") else load(spark, path)


def mimic_iv_omop(spark: SparkSession, path: str) -> Catalog:
    """The demo tables, whose files have the prefix 2b_ where they are no part of the model's own."""
    return setup_connection(spark, path, prefix="2b_")


def gibleed_omop(spark: SparkSession, path: str) -> Catalog:
    return setup_connection(spark, path)


synthea27nj_omop = gibleed_omop
