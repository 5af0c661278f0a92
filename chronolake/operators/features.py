"""Feature types, missing texts and casts of a cube's variables."""

from __future__ import annotations

import logging
import warnings
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spec import MISSING
from .cube import Cube, pinned

log = logging.getLogger(__name__)
TYPES = ("numeric", "categorical", "date")
#: ISO 8601 dates: year, month or day, basic or extended, week dates, with an optional time.
ISO_DATE = r"^\d{4}(-?(0[1-9]|1[0-2])(-?(0[1-9]|[12]\d|3[01]))?|-?W(0[1-9]|[1-4]\d|5[0-3])(-?[1-7])?)?([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def classified(kind: T.DataType, value: Column, binary_as: str = "categorical") -> dict[str, Column]:
    """Counters of a variable's values and the type they lead to, all in one aggregation."""
    text = isinstance(kind, T.StringType)
    number = value.try_cast("double") if text else value.cast("double")
    n, n_iso = F.count(value), F.count_if(value.rlike(ISO_DATE)) if text else F.lit(0)
    n_number = F.count(number)
    low, high, others = F.min(number), F.max(number), F.count_if(~number.isin(0.0, 1.0))
    dates = F.lit(isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType)) | (F.lit(text) & (n > 0) & (n_iso == n) & (n_number < n))
    other = F.lit(isinstance(kind, T.BooleanType)) | (n_number < n)
    binary = (others == 0) & (low == 0) & (high == 1)
    feature = F.when(n == 0, None).when(dates, "date").when(other, "categorical").when(binary, "numeric" if binary_as == "numeric" else "categorical").otherwise("numeric")
    return {"n": n, "feature_type": feature, "uncertain": F.coalesce(binary & ~other & ~dates, F.lit(False))}


def infer_feature_types(cube: Cube, *, layer: str | None = None, output: str | None = None, binary_as: str = "categorical", verbose: bool = True) -> Cube | DataFrame:
    """var with feature_type and uncertain; labels that are there already stay.

    output: "tree" also prints the types, "dataframe" returns var_name and feature_type in place of
    the cube.  verbose warns of numbers that were taken for categories.  Without X and layer, the first layer by name counts.
    """
    if output not in ("tree", "dataframe", None):
        raise ValueError("output must be tree, dataframe or None")
    name = layer or ("X" if "X" in cube.layers else min(cube.layers))
    if layer is None and name != "X":
        warnings.warn(f"The cube has no layer X; feature types come from layer '{name}'.", UserWarning, stacklevel=2)
    cells = cube.layers[name].cells
    kind = dict((f.name, f.dataType) for f in cells.schema)["value"]
    # a row for each variable, read three times from here on
    got = pinned(cells.where("value IS NOT NULL").groupBy("var_idx").agg(*[c.alias(k) for k, c in classified(kind, F.col("value"), binary_as).items()]))
    old = F.col("feature_type") if "feature_type" in cube.var.columns else F.lit(None)
    var = cube.var.withColumn("_old", old).drop("feature_type", "uncertain").join(got.drop("n"), "var_idx", "left")
    var = var.withColumn("feature_type", F.coalesce("_old", "feature_type")).withColumn("uncertain", F.col("_old").isNull() & F.coalesce("uncertain", F.lit(False))).drop("_old")
    if empty := [r[0] for r in var.where("feature_type IS NULL").select("var_name").limit(20).collect()]:
        raise ValueError(f"features without any value: {empty}")
    if verbose and (unsure := [r[0] for r in var.where("uncertain").select("var_name").orderBy("var_name").limit(100).collect()]):
        log.warning("Features with values 0 and 1 were taken as categorical: %s", unsure)
    out = replace(cube, var=var)
    if output == "tree":
        feature_type_overview(out, name)
    return var.select("var_name", "feature_type") if output == "dataframe" else out


def categories(cube: Cube, layer: str = "X") -> DataFrame:
    """var_idx and the number of different values of each variable."""
    return cube.layers[layer].cells.groupBy("var_idx").agg(F.count_distinct("value").alias("categories"))


def feature_type_overview(cube: Cube, layer: str = "X") -> DataFrame:
    """var_name, feature_type and, of categorical features, the number of categories; prints a tree."""
    out = cube.var.join(categories(cube, layer), "var_idx", "left").select("var_name", "feature_type", F.when(F.col("feature_type") == "categorical", F.col("categories")).alias("categories")).orderBy("feature_type", "var_name")
    for kind in ("date", "numeric", "categorical"):
        print(f"{kind} features")
        for r in out.where(F.col("feature_type") == kind).toLocalIterator():
            print(f"  {r['var_name']}" + (f"; {r['categories']} categories" if r["categories"] is not None else ""))
    return out


def replace_feature_types(cube: Cube, features: str | Sequence[str], corrected_type: str) -> Cube:
    if "feature_type" not in cube.var.columns:
        raise ValueError("feature types have not been inferred")
    if corrected_type not in TYPES:
        raise ValueError(f"corrected_type must be one of {TYPES}")
    names = [features] if isinstance(features, str) else list(features)
    found = {r[0] for r in cube.var.where(F.col("var_name").isin(names)).select("var_name").collect()}
    if missing := set(names) - found:
        raise KeyError(sorted(missing)[0])
    return replace(cube, var=cube.var.withColumn("feature_type", F.when(F.col("var_name").isin(names), corrected_type).otherwise(F.col("feature_type"))))


def without_missing(value: Column, missing: Sequence[str] = MISSING) -> Column:
    return F.when(value.isin(list(missing)), None).otherwise(value)


def harmonize_missing_values(cube: Cube, *, layer: str | None = None, missing_values: Sequence[str] = MISSING) -> Cube:
    """Texts that mean missing become missing; numbers and flags stay. Without layer, in all layers."""
    layers = dict(cube.layers)
    for name in [layer] if layer else list(layers):
        cells = layers[name].cells
        if dict(cells.dtypes)["value"] == "string":
            layers[name] = replace(layers[name], cells=cells.withColumn("value", without_missing(F.col("value"), missing_values)))
    return replace(cube, layers=layers)


def castable(cells: DataFrame) -> DataFrame:
    """var_idx and whether every value of the variable is a number."""
    return cells.groupBy("var_idx").agg((F.count_if(F.col("value").isNotNull() & F.col("value").try_cast("double").isNull()) == 0).alias("is_number"))


def cast_variables_to_float(cube: Cube, layer: str = "X") -> Cube:
    """A text layer as doubles if all of its variables are numbers; else only those are normalised as text."""
    cells = cube.layers[layer].cells
    if dict(cells.dtypes)["value"] != "string":
        return cube
    good = castable(cells)
    if good.where("NOT is_number").isEmpty():
        out = cells.withColumn("value", F.col("value").try_cast("double"))
    else:
        value = F.when(F.col("is_number"), F.col("value").try_cast("double").cast("string")).otherwise(F.col("value"))
        out = cells.join(good, "var_idx").withColumn("value", value).select(*cells.columns)
    return replace(cube, layers=cube.layers | {layer: replace(cube.layers[layer], cells=out)})
