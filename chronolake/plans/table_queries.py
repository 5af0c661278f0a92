"""Queries of observations, concepts, units and feature typing."""

from __future__ import annotations

import sys
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spec import EVENT_TABLES
from ..operators.cohort import AtLeast, Events, attrition, cohort, index_times
from ..operators.cube import Cube, Layer, with_ordinals
from ..operators.export import labelled_tensors, mortality
from ..operators.feed import TensorFeed, write_feed
from ..operators.extraction import distinct_concepts, enriched, first_rows, long_table, observation_rows, periods, remapped, setup_interval_variables, setup_obs, setup_variables, unit_report
from ..operators.features import cast_variables_to_float, castable, categories, harmonize_missing_values, infer_feature_types
from ..operators.reshape import from_frame, to_long
from ..sources.catalog import Catalog, setup_connection
from ..sources.loaders import binned_long, challenge_cube, read_csv, recoded_flag
from ..sources.scratch import shared_dir
from .roles import SQL_ROLES, measurements, table, users

# executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Concept codes of the event types.
CODES = {"click": 11, "purchase": 12, "signup": 13, "error": 14, "view": 15}
KINDS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CODES.items()) + " ELSE 19 END"


def catalog(spark: SparkSession, sf_dir: str, cohort: str = "user_id % 3 = 0") -> Catalog:
    """The driver's tables as medical-record tables; cohort is a condition on its users."""
    customer, orders, events = (table(spark, sf_dir, t) for t in ("customer", "orders", "events"))
    month = F.expr("INTERVAL '30' DAY")
    per_user = events.groupBy("user_id").agg(F.min("ts").cast("date").alias("_d"))
    return Catalog(spark, {
        "person": customer.select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("location_id"), (F.lit("1950-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("c_custkey").cast("int"))).alias("birth_datetime")),
        "visit_occurrence": orders.select(F.col("o_orderkey").alias("visit_occurrence_id"), F.col("o_custkey").alias("person_id"), F.col("o_orderstatus").alias("visit_source_value"), F.col("o_orderdate").cast("date").alias("visit_start_date"), F.col("o_orderdate").alias("visit_start_datetime"), (F.col("o_orderdate").cast("timestamp_ntz") + month).alias("visit_end_datetime"), (F.col("o_orderdate").cast("timestamp_ntz") + month).cast("date").alias("visit_end_date")),
        "observation_period": per_user.select((F.col("user_id") + 5000).alias("observation_period_id"), F.col("user_id").alias("person_id"), F.col("_d").alias("observation_period_start_date"), F.date_add("_d", 30).alias("observation_period_end_date")),
        "cohort": per_user.where(cohort).select(F.lit(1).alias("cohort_definition_id"), F.col("user_id").alias("subject_id"), F.col("_d").alias("cohort_start_date"), F.date_add("_d", 30).alias("cohort_end_date")),
        "death": customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("person_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("c_custkey") % 60).cast("int"))).alias("death_datetime")),
        "measurement": events.select(F.col("event_id").alias("measurement_id"), F.col("user_id").alias("person_id"), F.expr(KINDS).alias("measurement_concept_id"), F.col("ts").cast("date").alias("measurement_date"), F.col("ts").alias("measurement_datetime"), F.when(F.col("event_id") % 7 == 0, None).otherwise(F.floor("value").cast("double") % 5).alias("value_as_number"), F.when(F.col("event_id") % 3 != 2, 100 + F.col("event_id") % 3).alias("unit_concept_id")),
        "drug_exposure": events.select(F.col("event_id").alias("drug_exposure_id"), F.col("user_id").alias("person_id"), F.expr(KINDS).alias("drug_concept_id"), F.col("ts").cast("date").alias("drug_exposure_start_date"), F.col("ts").alias("drug_exposure_start_datetime"), (F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("event_id") % 90).cast("int"))).alias("drug_exposure_end_datetime"), (F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("event_id") % 90).cast("int"))).cast("date").alias("drug_exposure_end_date"), F.col("event_id").cast("double").alias("days_supply")),
        "concept": spark.createDataFrame([(c, f"concept {c}") for c in (11, 12, 13, 91)], "concept_id int, concept_name string"),
        "concept_relationship": spark.createDataFrame([(14, 91, "Mapped from"), (15, 90, "Mapped from"), (15, 92, "Maps to"), (15, 15, "Mapped from"), (11, 93, "Mapped from")], "concept_id_1 int, concept_id_2 int, relationship_id string"),
    })


def obs_rows(name: str, *columns: str, death: bool = False, **of):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return observation_rows(catalog(spark, sf_dir, **of), name, death)[0].select(*columns)

    return query


def obs_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, key = observation_rows(catalog(spark, sf_dir), "person_visit_occurrence")
    return with_ordinals(rows.select("person_id", key), "obs_idx", [F.col(key)]).select("obs_idx", key, "person_id")


def first_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_rows(catalog(spark, sf_dir)["visit_occurrence"], ["person_id"], ["visit_start_datetime", "visit_occurrence_id"]).select("person_id", "visit_occurrence_id")


def _variables(c: Catalog, name: str = "measurement") -> DataFrame:
    return c[name].select(F.col(f"{name}_concept_id").alias("data_table_concept_id")).distinct()


def concept_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts with their own rows of the concept table, where no relationships are known."""
    c = catalog(spark, sf_dir)
    bare = Catalog(spark, {"concept": c["concept"]})
    return enriched(_variables(c), bare, None, True, False).select(F.col("data_table_concept_id").alias("concept_id"), "concept_name")


def enrich_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts with the names of what they are mapped from, and the unit of those that have one only."""
    c = catalog(spark, sf_dir)
    concept = F.col("measurement_concept_id")
    c.register("measurement", c["measurement"].withColumn("unit_concept_id", F.when(concept <= 12, 10 * concept).otherwise(F.col("unit_concept_id")).cast("int")))
    c.register("concept", c["concept"].union(spark.createDataFrame([(110, "unit 110")], "concept_id int, concept_name string")))
    out = enriched(_variables(c), c, unit_report(c["measurement"], EVENT_TABLES["measurement"]), True, True)
    return out.select(F.col("data_table_concept_id").alias("concept"), "data_table_concept_id_mapped", "concept_name", F.col("unit_concept_id").cast("double").alias("unit"), F.col("concept_name_unit_concept").alias("unit_name"))


def concept_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return remapped(c["measurement"].select(F.col("measurement_concept_id").alias("concept")).distinct(), c)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = unit_report(catalog(spark, sf_dir)["measurement"], EVENT_TABLES["measurement"])
    return out.select("concept_id", F.col("unit_concept_id").cast("double").alias("unit_concept_id"), "no_units", "multiple_units")


def var_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_concepts(catalog(spark, sf_dir), "measurement")


def _extracted(spark, sf_dir, **more) -> Cube:
    c = catalog(spark, sf_dir)
    cube = setup_obs(c, "person_observation_period", death_table=True)
    return setup_variables(cube, c, data_tables=["measurement"], data_field_to_keep=["value_as_number"], interval_length_number=1, interval_length_unit="day", num_intervals=5, time_precision="datetime", **more)


def extract_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation periods x measurement concepts x 5 days, as a dense long table."""
    cube = _extracted(spark, sf_dir)
    return to_long(cube).select(F.col("observation_id").cast("long").alias("obs"), F.col("variable").cast("long").alias("concept"), F.col("time").cast("long").alias("step"), "value")


def extract_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract_points for two concepts."""
    cube = _extracted(spark, sf_dir, concept_ids=[11, 14])
    return to_long(cube).select(F.col("observation_id").cast("long").alias("obs"), F.col("variable").cast("long").alias("concept"), F.col("time").cast("long").alias("step"), "value")


def extract_two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two event tables as one layer; variables by table, then concept."""
    c = catalog(spark, sf_dir)
    c.register("observation", c["measurement"].where("measurement_concept_id <> 13").toDF(*[x.replace("measurement", "observation") for x in c["measurement"].columns]))
    cube = setup_variables(setup_obs(c, "person_observation_period"), c, data_tables=["measurement", "observation"], data_field_to_keep={"measurement": "value_as_number", "observation": "observation_id"}, interval_length_number=1, interval_length_unit="day", num_intervals=5, aggregation_strategy="count")
    return cube.X.cells.select(F.col("obs_idx").cast("long").alias("obs"), F.col("var_idx").cast("long").alias("var"), F.col("t_idx").cast("long").alias("step"), F.col("value").cast("long").alias("value"))


def tensor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed tensors with mortality within the observation: the label, and the sum of what is packed."""
    c = catalog(spark, sf_dir)
    rows = labelled_tensors(_extracted(spark, sf_dir), c)
    total = F.aggregate(F.filter(F.flatten("features"), lambda x: ~F.isnan(x)), F.lit(0.0), lambda a, x: a + x)
    return rows.select(F.col("obs_idx").cast("long").alias("obs"), F.col("label").cast("long").alias("label"), total.alias("total"))


def _shards(path: str, shards: int):
    def run(batches):
        import pyarrow as pa

        feed = TensorFeed(path)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                rows = [(obs, int(label), float(np.nansum(x.astype(float)))) for obs, x, label in feed.read(shard, shards, seed=3, epoch=1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["obs", "label", "total"])

    return run


def tensor_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tensor_labels by four readers of an epoch, each of which reads its row groups in an order of its own, without Spark."""
    path = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    write_feed(labelled_tensors(_extracted(spark, sf_dir), catalog(spark, sf_dir)), path, group_bytes=1 << 16)
    return spark.range(4).repartition(4).mapInArrow(_shards(path, 4), "obs long, label long, total double")


def catalog_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record tables written as CSV in two dialects and read back by their folder: names, types, dates and leading zeros."""
    c, folder = catalog(spark, sf_dir), f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    rows = c["measurement"].withColumn("measurement_source_value", F.lpad(F.col("measurement_id").cast("string"), 9, "0"))
    rows.toDF(*[n.upper() for n in rows.columns]).write.option("header", True).option("sep", ";").csv(f"{folder}/Measurement.csv")
    c["death"].write.option("header", True).csv(f"{folder}/death.csv")
    back = setup_connection(spark, folder)
    dead = back["death"].select(F.col("person_id").alias("_of"), F.col("death_datetime").alias("death"))
    out = back["measurement"].join(dead, F.col("person_id") == F.col("_of"), "left")
    return out.select(
        F.col("measurement_id").cast("long").alias("id"), F.col("person_id").cast("long").alias("person_id"), F.col("measurement_concept_id").cast("long").alias("concept"), F.col("measurement_date").alias("day"),
        F.col("value_as_number").cast("double").alias("value"), F.col("measurement_source_value").alias("source"), "death",
    )


def cube_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a flat cube from a tab-separated file: numbers as variables, the segment with the observations."""
    path = f"{shared_dir(spark)}/customers-{uuid.uuid4().hex}.csv"
    table(spark, sf_dir, "customer").drop("c_name").write.option("header", True).option("sep", "\t").csv(path)
    cube = read_csv(spark, path, index_column="c_custkey", columns_obs_only=["c_mktsegment"])
    cells = cube.X.cells.join(cube.obs.select("obs_idx", "obs_name", "c_mktsegment"), "obs_idx").join(cube.var.select("var_idx", "var_name"), "var_idx")
    return cells.where("var_name <> 'c_custkey'").select("obs_name", "var_name", F.col("value").cast("double").alias("value"), F.col("c_mktsegment").alias("segment"))


def cohort_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cohort of persons outside the death table whose first event comes two hours or later into the observation period, with those hours."""
    c = catalog(spark, sf_dir)
    events, periods_ = Events(c["measurement"], "measurement_datetime"), Events(c["observation_period"], "observation_period_start_date")
    steps = {"gap": AtLeast(periods_, before=-2, unit="h"), "alive": ~AtLeast(Events(c["death"]))}
    began = c["observation_period"].select(F.col("person_id").alias("_of"), F.col("observation_period_start_date").cast("timestamp_ntz").alias("_began"))
    rows = cohort(index_times(events), steps).join(began, F.col("person_id") == F.col("_of"))
    return rows.select("person_id", F.timestamp_diff("HOUR", F.col("_began"), F.col("index")).alias("hours"))


def _steps(c: Catalog) -> tuple[DataFrame, dict]:
    """The first purchase as index, and steps of all kinds: counts, windows on both sides, exclusion, alternatives, another table."""
    events, kind = Events(c["measurement"], "measurement_datetime"), F.col("measurement_concept_id")
    index = index_times(events, kind == CODES["purchase"])
    steps = {
        "a click in the ten days before": AtLeast(events, kind == CODES["click"], after=-10, before=0),
        "no error within two days": ~AtLeast(events, kind == CODES["error"], after=-2, before=2),
        "two views, or a signup later": AtLeast(events, kind == CODES["view"], n=2) | AtLeast(events, kind == CODES["signup"], after=0),
        "alive": ~AtLeast(Events(c["death"])),
    }
    return index, steps


def cohort_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons who pass all steps, with their index time."""
    index, steps = _steps(catalog(spark, sf_dir))
    return cohort(index, steps).select("person_id", F.col("index").alias("index_time"))


def cohort_attrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons left and lost step by step."""
    index, steps = _steps(catalog(spark, sf_dir))
    return attrition(index, steps).select(F.col("step").cast("long").alias("step"), "name", "n", "lost", "alone")


def challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube of users, two parameters and 48 hours; some records dropped, one value meaning missing, the first value of an hour."""
    rows = measurements(spark, sf_dir).join(users(spark, sf_dir).select("person_id", "start_date"), "person_id")
    hours = F.timestamp_diff("MICROSECOND", F.col("start_date"), F.col("at")) / F.lit(3.6e9)
    rows = rows.select(F.col("person_id").alias("record"), F.col("concept").alias("parameter"), hours.alias("hours"), "value", F.struct("at", "event_id").alias("position"))
    obs = users(spark, sf_dir).select(F.col("person_id").alias("record"))
    cube = challenge_cube(rows, obs, ["view", "click"], keep="first", drop=[3, 5], null_if={"click": 4.0})
    cells = cube.layers["tem_data"].cells.join(cube.obs.select("obs_idx", "record"), "obs_idx")
    return cells.select("record", F.col("var_idx").cast("long").alias("var"), F.col("t_idx").cast("long").alias("step"), "value")


def long_statics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long frame with a variable that stays with the observations: static values and the number of cells."""
    rows = measurements(spark, sf_dir).where("value IS NOT NULL").groupBy(F.col("person_id").alias("observation_id"), F.col("concept").alias("variable"), F.dayofmonth("at").cast("long").alias("time")).agg(F.max("value").alias("value"))
    fixed = users(spark, sf_dir).select(F.col("person_id").alias("observation_id"), F.lit("half").alias("variable"), F.lit(1).cast("long").alias("time"), (F.col("person_id") / 2).alias("value"))
    cube = from_frame(rows.unionByName(fixed), format="long", columns_obs_only=["half"])
    counts = cube.X.cells.groupBy("obs_idx").agg(F.count("*").alias("n"))
    return cube.obs.join(counts, "obs_idx", "left").select("obs_name", "half", F.coalesce("n", F.lit(0)).alias("n"))


def extract_spans(spark: SparkSession, sf_dir: str, **of) -> DataFrame:
    c = catalog(spark, sf_dir, **of)
    cube = setup_interval_variables(setup_obs(c, "person_cohort"), c, data_tables=["drug_exposure"], data_field_to_keep=["is_present"], interval_length_number=12, interval_length_unit="h", num_intervals=8, keep_date="interval")
    return to_long(cube).select(F.col("observation_id").cast("long").alias("obs"), F.col("variable").cast("long").alias("concept"), F.col("time").cast("long").alias("step"), F.col("value").cast("double").alias("value"))


def extract_spans_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract_spans with all users in the cohort."""
    return extract_spans(spark, sf_dir, cohort="true")


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables of two tables side by side, by table and concept."""
    c = catalog(spark, sf_dir)
    cube = setup_obs(c, "person_observation_period")
    out = None
    for k, (name, field) in enumerate((("measurement", "value_as_number"), ("drug_exposure", "days_supply"))):
        cells, _ = long_table(cube, c[name], EVENT_TABLES[name], [field], length=86_400_000_000, count=5, strategy="count", precision="datetime")
        rows = cells.select(F.lit(k).alias("table_number"), "concept", F.col("obs_id").cast("long").alias("obs"), F.col("interval_step").cast("long").alias("step"), F.col(field).cast("bigint").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def mortality_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    rows = periods(setup_obs(c, "person_observation_period"), "date").join(c["death"], "person_id", "left")
    return rows.select("person_id", mortality(rows, "start_date", "end_date").cast("long").alias("label"))


def recode_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", recoded_flag(F.col("toxic")).cast("long").alias("flag"))


def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of a user, type and day: one bin for each day."""
    day = F.to_date("ts").cast("timestamp_ntz").alias("day")
    rows = table(spark, sf_dir, "events").select(F.struct("user_id", day).alias("record"), F.col("event_type").alias("parameter"), F.lit(0.0).alias("hours"), "value", F.struct("ts", "event_id").alias("position"))
    return binned_long(rows, length=1.0, count=1, keep="last").select("record.user_id", F.col("parameter").alias("event_type"), "record.day", "value")


def _text_cube(spark, sf_dir) -> Cube:
    """Five variables of parts as texts: numbers, categories, dates, flags and numbers with missing texts."""
    part = table(spark, sf_dir, "part")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd")
    mixed = F.when(F.col("p_partkey") % 9 == 0, "np.nan").otherwise(F.col("p_size").cast("string"))
    values = [F.col("p_size").cast("string"), F.col("p_brand"), day, (F.col("p_partkey") % 2).cast("string"), mixed]
    cells = part.select(F.col("p_partkey").alias("obs_idx"), F.posexplode(F.array(*values)).alias("var_idx", "value"))
    var = spark.createDataFrame(list(enumerate(["size", "brand", "day", "flag", "mixed"])), "var_idx int, var_name string")
    obs = part.select(F.col("p_partkey").alias("obs_idx"), F.col("p_partkey").cast("string").alias("obs_name"))
    return Cube.build(obs, var, None, {"X": Layer(cells, 2)}, n_t=1)


def harmonize(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = harmonize_missing_values(_text_cube(spark, sf_dir))
    return cube.X.cells.where("var_idx = 4").select(F.col("obs_idx").alias("part"), "value")


def feature_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer_feature_types(harmonize_missing_values(_text_cube(spark, sf_dir))).var.select("var_name", "feature_type", "uncertain")


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _text_cube(spark, sf_dir)
    return cube.var.join(categories(cube), "var_idx").select("var_name", "categories")


def cast_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _text_cube(spark, sf_dir)
    return cube.var.join(castable(cube.X.cells), "var_idx").select("var_name", "is_number")


def cast_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a text layer in one form, where some other variable keeps the layer from becoming numbers."""
    cube = cast_variables_to_float(harmonize_missing_values(_text_cube(spark, sf_dir)))
    return cube.X.cells.join(cube.var, "var_idx").select(F.col("obs_idx").alias("part"), "var_name", "value")


QUERIES = {
    "obs_person": obs_rows("person", "person_id", "location_id", "birth_datetime"),
    "obs_visit": obs_rows("person_visit_occurrence", "person_id", "visit_occurrence_id", "person_id_1", "visit_source_value"),
    "obs_period": obs_rows("person_observation_period", "person_id", "observation_period_id", "location_id"),
    "obs_cohort": obs_rows("person_cohort", "person_id", "subject_id", "cohort_definition_id"),
    "obs_cohort_all": obs_rows("person_cohort", "person_id", "subject_id", "cohort_definition_id", cohort="true"),
    "obs_death_left": obs_rows("person", "person_id", "death_datetime", death=True),
    "obs_index_rank": obs_index, "first_visit_rank": first_visit, "concept_enrich": concept_enrich, "concept_remap": concept_remap, "unit_report": units,
    "var_distinct": var_distinct, "extract_points": extract_points, "extract_spans": extract_spans, "extract_spans_all": extract_spans_all, "stack_tables": stacked, "mortality_label": mortality_label,
    "recode_flag": recode_flag, "dedup_keep_last": dedup_keep_last, "harmonize_missing": harmonize, "infer_feature_types": feature_types,
    "category_counts": category_counts, "cast_float_all_or_nothing": cast_float, "cast_float_values": cast_values, "enrich_units": enrich_units,
    "extract_concepts": extract_concepts, "extract_two_tables": extract_two_tables, "tensor_labels": tensor_labels, "cohort_sql": cohort_sql,
    "catalog_csv": catalog_csv, "cube_csv": cube_csv, "tensor_feed": tensor_feed, "cohort_members": cohort_members, "cohort_attrition": cohort_attrition,
    "challenge_cube": challenge, "long_statics": long_statics,
}

_FIRST = "(SELECT user_id, CAST(min(ts) AS DATE) AS d FROM events GROUP BY user_id)"
_M = f"(SELECT *, CAST({KINDS} AS BIGINT) AS concept, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(value) AS DOUBLE) % 5 END AS v FROM events)"
_PERIODS = f"p AS (SELECT user_id, CAST(d AS TIMESTAMP) AS zero, row_number() OVER (ORDER BY user_id) - 1 AS obs FROM {_FIRST} WHERE user_id IN (SELECT c_custkey FROM customer))"
_STEPS = """WITH i AS (SELECT user_id, min(ts) AS zero FROM events WHERE event_type = 'purchase' GROUP BY user_id),
flags AS (SELECT e.user_id, zero, count(*) FILTER (event_type = 'click' AND ts BETWEEN zero - INTERVAL 10 DAY AND zero) > 0 AS s1, count(*) FILTER (event_type = 'error' AND ts BETWEEN zero - INTERVAL 2 DAY AND zero + INTERVAL 2 DAY) = 0 AS s2,
  count(*) FILTER (event_type = 'view') >= 2 OR count(*) FILTER (event_type = 'signup' AND ts >= zero) > 0 AS s3, e.user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) AS s4 FROM i JOIN events e ON e.user_id = i.user_id GROUP BY e.user_id, zero)"""
_PARTS = """texts AS (
  SELECT p_partkey AS part, unnest(['size', 'brand', 'day', 'flag', 'mixed']) AS var_name,
         unnest([CAST(p_size AS VARCHAR), p_brand, strftime(DATE '2020-01-01' + p_size, '%Y-%m-%d'), CAST(p_partkey % 2 AS VARCHAR),
                 CASE WHEN p_partkey % 9 = 0 THEN 'np.nan' ELSE CAST(p_size AS VARCHAR) END]) AS value
  FROM part)"""
SQL = {
    "obs_person": "SELECT c_custkey AS person_id, c_nationkey AS location_id, TIMESTAMP '1950-01-01' + to_days(CAST(c_custkey AS INTEGER)) AS birth_datetime FROM customer",
    "obs_visit": "SELECT c_custkey AS person_id, o_orderkey AS visit_occurrence_id, o_custkey AS person_id_1, o_orderstatus AS visit_source_value FROM customer JOIN orders ON c_custkey = o_custkey",
    "obs_period": f"SELECT c_custkey AS person_id, user_id + 5000 AS observation_period_id, c_nationkey AS location_id FROM customer JOIN {_FIRST} ON c_custkey = user_id",
    "obs_cohort": f"SELECT c_custkey AS person_id, user_id AS subject_id, 1 AS cohort_definition_id FROM customer JOIN {_FIRST} ON c_custkey = user_id WHERE user_id % 3 = 0",
    "obs_cohort_all": f"SELECT c_custkey AS person_id, user_id AS subject_id, 1 AS cohort_definition_id FROM customer JOIN {_FIRST} ON c_custkey = user_id",
    "obs_death_left": "SELECT c_custkey AS person_id, CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 60 AS INTEGER)) END AS death_datetime FROM customer",
    "obs_index_rank": "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS obs_idx, o_orderkey AS visit_occurrence_id, o_custkey AS person_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)",
    "first_visit_rank": "SELECT o_custkey AS person_id, o_orderkey AS visit_occurrence_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1",
    "concept_enrich": f"SELECT DISTINCT CAST(concept AS INTEGER) AS concept_id, CASE WHEN concept IN (11, 12, 13) THEN 'concept ' || concept END AS concept_name FROM {_M}",
    "concept_remap": f"SELECT DISTINCT CAST(concept AS INTEGER) AS concept, CAST(CASE concept WHEN 14 THEN 91 WHEN 15 THEN 90 ELSE concept END AS INTEGER) AS mapped FROM {_M}",
    "unit_report": f"WITH x AS (SELECT DISTINCT CAST(concept AS INTEGER) AS concept_id, CAST(CASE WHEN event_id % 3 <> 2 THEN 100 + event_id % 3 END AS DOUBLE) AS unit_concept_id FROM {_M}) SELECT concept_id, unit_concept_id, false AS no_units, count(*) OVER (PARTITION BY concept_id) > 1 AS multiple_units FROM x",
    "var_distinct": f"SELECT DISTINCT CAST(concept AS INTEGER) AS concept FROM {_M}",
    "extract_points": f"""WITH {_PERIODS}, c AS (SELECT DISTINCT concept FROM {_M}), s AS (SELECT unnest(range(5)) AS step)
SELECT p.obs, c.concept, s.step, LAST(m.v ORDER BY m.ts, m.event_id) AS value
FROM p CROSS JOIN c CROSS JOIN s LEFT JOIN {_M} m ON m.user_id = p.user_id AND m.concept = c.concept
  AND m.ts >= p.zero + s.step * INTERVAL 1 DAY AND m.ts < p.zero + (s.step + 1) * INTERVAL 1 DAY GROUP BY p.obs, c.concept, s.step""",
    "extract_spans": f"""WITH p AS (SELECT user_id, CAST(d AS TIMESTAMP) AS zero, row_number() OVER (ORDER BY user_id) - 1 AS obs FROM {_FIRST} WHERE user_id % 3 = 0 AND user_id IN (SELECT c_custkey FROM customer)),
c AS (SELECT DISTINCT concept FROM {_M}), s AS (SELECT unnest(range(8)) AS step),
m AS (SELECT user_id, concept, event_id, ts AS a, ts + to_hours(CAST(event_id % 90 AS INTEGER)) AS b FROM {_M})
SELECT p.obs, c.concept, s.step, CAST(CASE WHEN count(m.event_id) > 0 THEN 1 END AS DOUBLE) AS value
FROM p CROSS JOIN c CROSS JOIN s LEFT JOIN m ON m.user_id = p.user_id AND m.concept = c.concept
  AND m.a < p.zero + (s.step + 1) * INTERVAL 12 HOUR AND m.b >= p.zero + s.step * INTERVAL 12 HOUR GROUP BY p.obs, c.concept, s.step""",
    "extract_spans_all": f"""WITH {_PERIODS}, c AS (SELECT DISTINCT concept FROM {_M}), s AS (SELECT unnest(range(8)) AS step),
m AS (SELECT user_id, concept, event_id, ts AS a, ts + to_hours(CAST(event_id % 90 AS INTEGER)) AS b FROM {_M})
SELECT p.obs, c.concept, s.step, CAST(CASE WHEN count(m.event_id) > 0 THEN 1 END AS DOUBLE) AS value
FROM p CROSS JOIN c CROSS JOIN s LEFT JOIN m ON m.user_id = p.user_id AND m.concept = c.concept
  AND m.a < p.zero + (s.step + 1) * INTERVAL 12 HOUR AND m.b >= p.zero + s.step * INTERVAL 12 HOUR GROUP BY p.obs, c.concept, s.step""",
    "stack_tables": f"""WITH {_PERIODS}, m AS (SELECT p.obs, m.concept, m.event_id, m.v, CAST(floor(date_diff('microsecond', p.zero, m.ts) / 86400000000) AS BIGINT) AS step FROM p JOIN {_M} m ON m.user_id = p.user_id)
SELECT 0 AS table_number, CAST(concept AS INTEGER) AS concept, obs, step, count(v) AS value FROM m WHERE step BETWEEN 0 AND 4 GROUP BY concept, obs, step
UNION ALL SELECT 1, CAST(concept AS INTEGER), obs, step, count(event_id) FROM m WHERE step BETWEEN 0 AND 4 GROUP BY concept, obs, step""",
    "mortality_label": f"""SELECT user_id AS person_id, CAST(CASE WHEN user_id % 10 = 0 AND TIMESTAMP '2024-01-01' + to_days(CAST(user_id % 60 AS INTEGER)) BETWEEN CAST(d AS TIMESTAMP) AND CAST(d + 30 AS TIMESTAMP) THEN 1 ELSE 0 END AS BIGINT) AS label
FROM {_FIRST} WHERE user_id IN (SELECT c_custkey FROM customer)""",
    "recode_flag": "SELECT doc_id, CAST(CASE WHEN toxic = 0 THEN 1 ELSE 0 END AS BIGINT) AS flag FROM labels",
    "dedup_keep_last": "SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, LAST(value ORDER BY ts, event_id) AS value FROM events GROUP BY user_id, event_type, CAST(ts AS DATE)",
    "harmonize_missing": f"WITH {_PARTS} SELECT part, CASE WHEN value NOT IN ('nan', 'np.nan', '<NA>', 'pd.NA') THEN value END AS value FROM texts WHERE var_name = 'mixed'",
    "infer_feature_types": f"""WITH {_PARTS}, present AS (SELECT var_name, value, TRY_CAST(value AS DOUBLE) AS number FROM texts WHERE value NOT IN ('nan', 'np.nan', '<NA>', 'pd.NA')),
stats AS (SELECT var_name, count(*) AS n, count(number) AS numbers, count(*) FILTER (regexp_full_match(value, '\\d{{4}}-\\d{{2}}-\\d{{2}}')) AS dates,
  count(DISTINCT number) = 2 AND min(number) = 0 AND max(number) = 1 AS two FROM present GROUP BY var_name)
SELECT var_name, CASE WHEN dates = n AND numbers < n THEN 'date' WHEN numbers < n OR two THEN 'categorical' ELSE 'numeric' END AS feature_type, two AND numbers = n AS uncertain FROM stats""",
    "category_counts": f"WITH {_PARTS} SELECT var_name, count(DISTINCT value) AS categories FROM texts GROUP BY var_name",
    "cast_float_values": f"""WITH {_PARTS}, present AS (SELECT part, var_name, CASE WHEN value NOT IN ('nan', 'np.nan', '<NA>', 'pd.NA') THEN value END AS value FROM texts),
good AS (SELECT var_name, bool_and(value IS NULL OR TRY_CAST(value AS DOUBLE) IS NOT NULL) AS fine FROM present GROUP BY var_name)
SELECT part, var_name, CASE WHEN fine THEN CAST(TRY_CAST(value AS DOUBLE) AS VARCHAR) ELSE value END AS value FROM present JOIN good USING (var_name)""",
    "enrich_units": f"""WITH m AS (SELECT DISTINCT CAST(concept AS INTEGER) AS concept, CASE WHEN concept <= 12 THEN 10 * concept WHEN event_id % 3 <> 2 THEN 100 + event_id % 3 END AS unit FROM {_M}),
single AS (SELECT concept, max(unit) AS unit FROM m GROUP BY concept HAVING count(*) = 1),
names AS (SELECT DISTINCT concept, CASE concept WHEN 14 THEN 91 WHEN 15 THEN 90 ELSE concept END AS mapped FROM m)
SELECT n.concept, CAST(mapped AS INTEGER) AS data_table_concept_id_mapped, CASE WHEN mapped IN (11, 12, 13, 91) THEN 'concept ' || mapped END AS concept_name,
  CAST(unit AS DOUBLE) AS unit, CASE WHEN unit = 110 THEN 'unit 110' END AS unit_name FROM names n LEFT JOIN single USING (concept)""",
    "extract_concepts": f"""WITH {_PERIODS}, c AS (SELECT DISTINCT concept FROM {_M} WHERE concept IN (11, 14)), s AS (SELECT unnest(range(5)) AS step)
SELECT p.obs, c.concept, s.step, LAST(m.v ORDER BY m.ts, m.event_id) AS value
FROM p CROSS JOIN c CROSS JOIN s LEFT JOIN {_M} m ON m.user_id = p.user_id AND m.concept = c.concept
  AND m.ts >= p.zero + s.step * INTERVAL 1 DAY AND m.ts < p.zero + (s.step + 1) * INTERVAL 1 DAY GROUP BY p.obs, c.concept, s.step""",
    "extract_two_tables": f"""WITH {_PERIODS}, e AS (SELECT 0 AS tab, *, v AS x FROM {_M} UNION ALL SELECT 1, *, CAST(event_id AS DOUBLE) FROM {_M} WHERE concept <> 13),
vars AS (SELECT tab, concept, row_number() OVER (ORDER BY tab, concept) - 1 AS var FROM (SELECT DISTINCT tab, concept FROM e))
SELECT p.obs, vars.var, CAST(floor(date_diff('microsecond', p.zero, e.ts) / 86400000000) AS BIGINT) AS step, count(e.x) AS value
FROM p JOIN e ON e.user_id = p.user_id JOIN vars ON vars.tab = e.tab AND vars.concept = e.concept
WHERE e.ts >= p.zero AND e.ts < p.zero + INTERVAL 5 DAY GROUP BY ALL""",
    "tensor_labels": f"""WITH {_PERIODS}, v AS (SELECT p.obs, m.concept, CAST(floor(date_diff('microsecond', p.zero, m.ts) / 86400000000) AS BIGINT) AS step, LAST(m.v ORDER BY m.ts, m.event_id) AS value
  FROM p JOIN {_M} m ON m.user_id = p.user_id WHERE m.ts >= p.zero AND m.ts < p.zero + INTERVAL 5 DAY GROUP BY ALL)
SELECT p.obs, CAST(CASE WHEN p.user_id % 10 = 0 AND TIMESTAMP '2024-01-01' + to_days(CAST(p.user_id % 60 AS INTEGER)) BETWEEN p.zero AND p.zero + INTERVAL 30 DAY THEN 1 ELSE 0 END AS BIGINT) AS label,
  coalesce((SELECT sum(value) FROM v WHERE v.obs = p.obs), 0) AS total FROM p""",
    "cohort_sql": f"""SELECT f.user_id AS person_id, date_diff('second', CAST(d AS TIMESTAMP), e.at) // 3600 AS hours
FROM {_FIRST} f JOIN (SELECT user_id, min(ts) AS at FROM events GROUP BY user_id) e USING (user_id)
WHERE f.user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) AND date_diff('second', CAST(d AS TIMESTAMP), e.at) >= 7200""",
    "cohort_members": f"{_STEPS} SELECT user_id AS person_id, zero AS index_time FROM flags WHERE s1 AND s2 AND s3 AND s4",
    "cohort_attrition": _STEPS + " UNION ALL ".join(
        f" SELECT CAST({k} AS BIGINT) AS step, '{name}' AS name, count(*) FILTER ({upto}) AS n, count(*) FILTER ({before}) - count(*) FILTER ({upto}) AS lost, count(*) FILTER ({alone}) AS alone FROM flags"
        for k, name, upto, before, alone in (
            (0, "all", "true", "true", "false"), (1, "a click in the ten days before", "s1", "true", "NOT s1"), (2, "no error within two days", "s1 AND s2", "s1", "NOT s2"),
            (3, "two views, or a signup later", "s1 AND s2 AND s3", "s1 AND s2", "NOT s3"), (4, "alive", "s1 AND s2 AND s3 AND s4", "s1 AND s2 AND s3", "NOT s4"),
        )
    ),
    "challenge_cube": f"""WITH {SQL_ROLES}, timed AS (SELECT m.*, date_diff('microsecond', u.start_date, m.ts) / 3.6e9 AS h FROM measurements m JOIN users u USING (person_id) WHERE person_id NOT IN (3, 5) AND concept IN ('view', 'click')),
kept AS (SELECT person_id, concept, greatest(0, CAST(ceil(h) AS BIGINT) - 1) AS step, FIRST(CASE WHEN concept = 'click' AND value = 4 THEN NULL ELSE value END ORDER BY ts, event_id) AS value FROM timed WHERE h <= 48 GROUP BY ALL)
SELECT person_id AS record, CAST(CASE WHEN concept = 'view' THEN 0 ELSE 1 END AS BIGINT) AS var, step, value FROM kept WHERE value IS NOT NULL""",
    "long_statics": f"""WITH {SQL_ROLES}, n AS (SELECT person_id, count(DISTINCT (concept, day(ts))) AS n FROM measurements WHERE value IS NOT NULL GROUP BY person_id)
SELECT CAST(u.person_id AS VARCHAR) AS obs_name, u.person_id / 2 AS half, coalesce(n, 0) AS n FROM users u LEFT JOIN n USING (person_id)""",
    "cast_float_all_or_nothing": f"WITH {_PARTS} SELECT var_name, bool_and(TRY_CAST(value AS DOUBLE) IS NOT NULL) AS is_number FROM texts GROUP BY var_name",
}
SQL["tensor_feed"] = SQL["tensor_labels"]
SQL["catalog_csv"] = f"""SELECT event_id AS id, user_id AS person_id, concept, CAST(ts AS DATE) AS day, v AS value, lpad(CAST(event_id AS VARCHAR), 9, '0') AS source,
CASE WHEN user_id % 10 = 0 AND user_id IN (SELECT c_custkey FROM customer) THEN TIMESTAMP '2024-01-01' + to_days(CAST(user_id % 60 AS INTEGER)) END AS death FROM {_M}"""
SQL["cube_csv"] = """SELECT CAST(c_custkey AS VARCHAR) AS obs_name, var_name, value, c_mktsegment AS segment
FROM (SELECT c_custkey, c_mktsegment, unnest(['c_nationkey', 'c_acctbal']) AS var_name, unnest([CAST(c_nationkey AS DOUBLE), c_acctbal]) AS value FROM customer)"""
