"""From a catalog of medical-record tables to a cube: observations, then variables of event tables."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.spec import EVENT_TABLES, OPEN_END, TIME_TABLES, EventTable, microseconds
from ..sources.catalog import Catalog
from .binning import binned, dense
from .cube import Cube, Layer, counted_ordinals, default_tem, pinned

log = logging.getLogger(__name__)
PERIOD = ["obs_id", "person_id", "start_date", "end_date"]


def joined_once(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Equality join that keeps all columns; a clashing column of the right side is named <column>_1."""
    right = right.toDF(*[f"{c}_1" if c in left.columns else c for c in right.columns])
    key = f"{right_key}_1" if right_key in left.columns else right_key
    return left.join(right, left[left_key] == right[key], how)


def observation_rows(catalog: Catalog, observation_table: str, death_table: bool = False) -> tuple[DataFrame, str]:
    """Rows of the observations and the column that identifies them; persons without rows drop out."""
    spec = TIME_TABLES[observation_table]
    person = catalog["person"]
    rows, key = person, "person_id"
    if observation_table != "person":
        rows, key = joined_once(person, catalog[spec.name], "person_id", spec.subject), spec.row_id
    if death_table:
        rows = joined_once(rows, catalog["death"], "person_id", "person_id", "left")
    return rows, key


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order, which leaves no ties; summed up before it is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(*keys, "_first.*").select(*df.columns)


def setup_obs(catalog: Catalog, observation_table: str, *, death_table: bool = False) -> Cube:
    """A cube whose observations are persons, cohort entries, observation periods or visits."""
    checks.check_catalog(catalog)
    checks.check_observation_table(observation_table)
    checks.check_flag(death_table, "death_table")
    rows, key = observation_rows(catalog, observation_table, death_table)
    obs, n = counted_ordinals(rows, "obs_idx", [F.col(key)])
    obs = obs.withColumn("obs_name", F.col("obs_idx").cast("string"))
    spark = catalog.spark
    var = spark.createDataFrame([], "var_idx int, var_name string")
    return Cube(obs, var, default_tem(spark, 1), n_obs=n, uns={"observation_table": observation_table})


def periods(cube: Cube, precision: str) -> DataFrame:
    """obs_id (the ordinal), person_id, start_date and end_date of a cube's observations."""
    table = cube.uns["observation_table"]
    spec = TIME_TABLES[table]
    exact = precision == "datetime" and spec.start_datetime
    if precision == "datetime" and not spec.start_datetime:
        log.warning("Time precision datetime not available for %s. Using '...date' and midnight.", spec.name)
    start, end = (spec.start_datetime, spec.end_datetime) if exact else (spec.start_date, spec.end_date)
    stop = F.col(end) if end else F.lit(OPEN_END)
    return cube.obs.select(F.col("obs_idx").alias("obs_id"), "person_id", F.col(start).cast("timestamp_ntz").alias("start_date"), stop.cast("timestamp_ntz").alias("end_date"))


def event_rows(events: DataFrame, spec: EventTable, fields: Sequence[str], side: str, precision: str) -> DataFrame:
    """Events in the form that binning takes; times of the chosen side and precision."""
    first, fell_back = spec.time_column("end" if side == "end" else "start", precision)
    if fell_back:
        log.warning("Time precision datetime not available for %s. Using '...date' and midnight.", spec.name)
    until = spec.time_column("end", precision)[0] if side == "interval" else None
    exact = [c for c in (spec.end_datetime if side == "end" else spec.start_datetime,) if c and c in events.columns]
    row_id = [c for c in (spec.row_id,) if c in events.columns]
    names = dict.fromkeys(f for f in fields if f != "is_present")
    return events.select(
        "person_id", F.col(spec.concept).alias("concept"), F.col(first).alias("at"), *([F.col(until).alias("until")] if until else []),
        *[F.col(c).alias(f"_order{k}") for k, c in enumerate(exact + row_id)], *names,
    )


def long_table(cube: Cube, events: DataFrame, spec: EventTable, fields: Sequence[str], *, length: int, count: int, strategy: str, precision: str, side: str = "start", concepts="all", units: bool = False, clip: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sparse bins, distinct concepts) of an event table over a cube's observations."""
    unit_columns = [c for c in ("unit_concept_id", "unit_source_value") if units and c in events.columns]
    rows = event_rows(events, spec, [*fields, *unit_columns], side, precision)
    if concepts != "all":
        rows = rows.where(F.col("concept").isin(list(concepts)))
    order = [c for c in rows.columns if c.startswith("_order")]
    cells = binned(periods(cube, precision), rows, length=length, count=count, fields=fields, strategy=strategy, last_fields=[c for c in unit_columns if c not in fields], span=side == "interval", order=order, clip_to_end=clip)
    return cells, rows.where(F.col("concept").isNotNull()).select("concept").distinct()


def distinct_concepts(catalog: Catalog, name: str, concepts="all") -> DataFrame:
    """concept: what the events of a table are about, each once; those of a list only, if one is given."""
    spec = EVENT_TABLES[name]
    out = catalog[name].select(F.col(spec.concept).alias("concept")).where(F.col("concept").isNotNull())
    return (out if concepts == "all" else out.where(F.col("concept").isin(list(concepts)))).distinct()


def remapped(concepts: DataFrame, catalog: Catalog) -> DataFrame:
    """mapped: the concept itself where the concept table has it, else the last one it was mapped from."""
    if "concept_relationship" not in catalog or "concept" not in catalog:
        return concepts.withColumn("mapped", F.col("concept"))
    relation = catalog["concept_relationship"].withColumn("_order", F.monotonically_increasing_id())
    relation = relation.where((F.col("relationship_id") == "Mapped from") & (F.col("concept_id_1") != F.col("concept_id_2")))
    source = relation.groupBy(F.col("concept_id_1").alias("concept")).agg(F.max_by("concept_id_2", "_order").alias("_source"))
    known = catalog["concept"].select(F.col("concept_id").alias("concept"), F.lit(True).alias("_known")).distinct()
    out = concepts.join(known, "concept", "left").join(source, "concept", "left")
    return out.withColumn("mapped", F.when(F.col("_known"), F.col("concept")).otherwise(F.coalesce("_source", "concept"))).drop("_known", "_source")


def unit_report(events: DataFrame, spec: EventTable) -> DataFrame:
    """concept_id, unit_concept_id, no_units, multiple_units: a row per concept and unit; no unit counts as one."""
    return _report(_pairs(events, spec))


def _pairs(events: DataFrame, spec: EventTable) -> DataFrame:
    """The concepts of a table with each unit they come in; null where the table has no units."""
    unit = F.col("unit_concept_id") if "unit_concept_id" in events.columns else F.lit(None).cast("int").alias("unit_concept_id")
    return events.where(F.col(spec.concept).isNotNull()).select(F.col(spec.concept).alias("concept_id"), unit).distinct()


def _report(pairs: DataFrame) -> DataFrame:
    each = pairs.groupBy("concept_id").agg(F.count("*").alias("_n"))
    return pairs.join(each, "concept_id").select("concept_id", "unit_concept_id", F.lit(False).alias("no_units"), (F.col("_n") > 1).alias("multiple_units"))


def _suffixed(df: DataFrame, taken: Sequence[str], suffix: str, key: str) -> DataFrame:
    return df.toDF(*[f"{c}{suffix}" if c in taken and c != key else c for c in df.columns])


def enriched(var: DataFrame, catalog: Catalog, report: DataFrame | None, features: bool, units: bool) -> DataFrame:
    """var with the concept's columns, and with its unit and the unit's concept columns."""
    out = var
    if features and "concept" in catalog:
        out = remapped(out.withColumnRenamed("data_table_concept_id", "concept"), catalog).withColumnRenamed("concept", "data_table_concept_id").withColumnRenamed("mapped", "data_table_concept_id_mapped")
        out = out.join(catalog["concept"], F.col("data_table_concept_id_mapped") == F.col("concept_id"), "left")
    if units and report is not None:
        single = report.where(~F.col("multiple_units"))
        own = _suffixed(single.withColumnRenamed("concept_id", "_of"), out.columns, "_unit", "_of")
        out = out.join(own, F.col("data_table_concept_id") == F.col("_of"), "left").drop("_of")
        if "concept" in catalog:
            unit = _suffixed(catalog["concept"].withColumnRenamed("concept_id", "_unit_id"), out.columns, "_unit_concept", "_unit_id")
            out = out.join(unit, F.col("unit_concept_id") == F.col("_unit_id"), "left").drop("_unit_id")
    return out


def _setup(cube: Cube, catalog: Catalog, *, layer, data_tables, data_field_to_keep, interval_length_number, interval_length_unit, num_intervals, concept_ids, aggregation_strategy, enrich_features, enrich_units, keep_date, time_precision, instantiate_tensor, clip_to_end, spans: bool) -> Cube:
    if not isinstance(cube, Cube):
        raise TypeError("Expected cube to be of type Cube.")
    checks.check_catalog(catalog)
    tables = checks.check_data_tables(data_tables, spans)
    fields = checks.check_fields(data_field_to_keep, tables)
    checks.check_intervals(interval_length_number, interval_length_unit, num_intervals)
    checks.check_concepts(concept_ids)
    checks.check_strategy(aggregation_strategy)
    checks.check_flag(enrich_features, "enrich_var_with_feature_info")
    checks.check_flag(enrich_units, "enrich_var_with_unit_info")
    checks.check_choice(keep_date, "keep_date", ["start", "end", "interval"])
    checks.check_choice(time_precision, "time_precision", ["date", "datetime"])
    if "observation_table" not in cube.uns:
        raise ValueError("setup_obs must be called before variables are set up.")
    checks.warn_on_precision(interval_length_unit, time_precision)
    if cube.uns["observation_table"] == "person" and not cube.obs.where("birth_datetime IS NULL").isEmpty():
        raise ValueError("observations are persons, but some have no birth_datetime")
    length = microseconds(interval_length_number, interval_length_unit)
    parts, layers, uns = [], [], dict(cube.uns)
    for position, name in enumerate(tables):
        # one scan gives the concepts and their units, a row for each of them
        pairs = pinned(_pairs(catalog[name], EVENT_TABLES[name])) if name in catalog else None
        if pairs is None or pairs.isEmpty():
            log.warning("No data in %s.", name)
            continue
        events, spec = catalog[name], EVENT_TABLES[name]
        concepts = pairs.select(F.col("concept_id").alias("concept")).distinct()
        concepts = concepts if concept_ids == "all" else concepts.where(F.col("concept").isin(list(concept_ids)))
        cells, _ = long_table(cube, events, spec, fields[name], length=length, count=num_intervals, strategy=aggregation_strategy, precision=time_precision, side=keep_date, concepts=concept_ids, units=not spans, clip=clip_to_end)
        report = _report(pairs) if not spans and "unit_concept_id" in events.columns else None
        if report is not None:
            uns[f"unit_report_{name}"] = report
            if many := report.where("multiple_units").select("concept_id").distinct().limit(20).collect():
                log.warning("Features with several units in %s: %s", name, [r[0] for r in many])
        uns[f"bins_of_{name}"] = dense(periods(cube, time_precision), concepts, cells, length=length, count=num_intervals, strategy=aggregation_strategy, fields=fields[name])
        var = concepts.select(F.col("concept").alias("data_table_concept_id")).withColumn("_table", F.lit(position))
        parts.append(enriched(var, catalog, report, enrich_features, enrich_units))
        layers.append((position, cells.select("obs_id", "concept", "interval_step", F.col(fields[name][0]).alias("value"))))
    if not parts:
        return cube
    var = parts[0]
    for p in parts[1:]:
        var = var.unionByName(p, allowMissingColumns=True)
    var, n_vars = counted_ordinals(var, "var_idx", [F.col("_table"), F.col("data_table_concept_id")])
    var = var.withColumn("var_name", F.col("data_table_concept_id").cast("string"))
    steps = default_tem(catalog.spark, num_intervals).withColumn("interval_step", F.col("t_idx"))
    out = replace(cube, var=var.drop("_table"), tem=steps, n_vars=n_vars, n_t=num_intervals, uns=uns)
    if not instantiate_tensor:
        return out
    place = var.select(F.col("data_table_concept_id").alias("concept"), "_table", "var_idx")
    cells = None
    for position, part in layers:
        here = part.join(F.broadcast(place.where(F.col("_table") == position)) if n_vars <= 100_000 else place.where(F.col("_table") == position), "concept")
        here = here.select(F.col("obs_id").alias("obs_idx"), "var_idx", F.col("interval_step").alias("t_idx"), "value").where("value IS NOT NULL")
        cells = here if cells is None else cells.unionByName(here)
    return replace(out, layers=cube.layers | {layer or "X": Layer(cells, 3, 0 if aggregation_strategy == "count" else None)})


def setup_variables(cube: Cube, catalog: Catalog, *, data_tables, data_field_to_keep, interval_length_number: int, interval_length_unit: str, num_intervals: int, layer: str | None = None, concept_ids="all", aggregation_strategy: str = "last", enrich_var_with_feature_info: bool = False, enrich_var_with_unit_info: bool = False, time_precision: str = "datetime", instantiate_tensor: bool = True, clip_to_end: bool = False) -> Cube:
    """Variables of measurement, observation and specimen; the first field becomes the layer."""
    return _setup(cube, catalog, layer=layer, data_tables=data_tables, data_field_to_keep=data_field_to_keep, interval_length_number=interval_length_number, interval_length_unit=interval_length_unit, num_intervals=num_intervals, concept_ids=concept_ids, aggregation_strategy=aggregation_strategy, enrich_features=enrich_var_with_feature_info, enrich_units=enrich_var_with_unit_info, keep_date="start", time_precision=time_precision, instantiate_tensor=instantiate_tensor, clip_to_end=clip_to_end, spans=False)


def setup_interval_variables(cube: Cube, catalog: Catalog, *, data_tables, data_field_to_keep, interval_length_number: int, interval_length_unit: str, num_intervals: int, layer: str | None = None, concept_ids="all", aggregation_strategy: str = "last", enrich_var_with_feature_info: bool = False, keep_date: str = "start", time_precision: str = "datetime", instantiate_tensor: bool = True, clip_to_end: bool = False) -> Cube:
    """Variables of tables whose rows are spans, by their start, their end or all steps they cover."""
    return _setup(cube, catalog, layer=layer, data_tables=data_tables, data_field_to_keep=data_field_to_keep, interval_length_number=interval_length_number, interval_length_unit=interval_length_unit, num_intervals=num_intervals, concept_ids=concept_ids, aggregation_strategy=aggregation_strategy, enrich_features=enrich_var_with_feature_info, enrich_units=False, keep_date=keep_date, time_precision=time_precision, instantiate_tensor=instantiate_tensor, clip_to_end=clip_to_end, spans=True)
