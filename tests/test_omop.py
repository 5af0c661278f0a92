"""Small record tables with known cubes."""

import math

import pytest

from chronolake import omop
from chronolake.operators.reshape import to_long

#: Person, first day of the period in March 2031, and the first dose level.
WARD = [(105, 4, 4), (110, 6, 9), (120, 7, 2), (130, 10, 7)]


def day(n, clock=None):
    return f"2031-03-{n:02d}" + (f" {clock}:00" if clock else "")


def csv(columns, rows):
    return "\n".join([columns, *(",".join(map(str, r)) for r in rows)]) + "\n"


PERSON = csv("person_id,gender_concept_id,birth_datetime", [(p, 1 + p % 2, "") for p in (140, 105, 130, 110, 120)])
PERIOD = csv("observation_period_id,person_id,observation_period_start_date,observation_period_end_date", [(900 + p, p, day(d), day(d + 14)) for p, d, _ in WARD])
VISIT = csv(
    "visit_occurrence_id,person_id,visit_start_date,visit_start_datetime,visit_end_date,visit_end_datetime",
    [(71, 110, day(6), day(6, "08:00"), day(7), day(7, "12:00")), (66, 110, day(8), day(8, "00:00"), day(9), day(9, "10:00")), (68, 130, day(20), day(20, "00:00"), day(22), day(22, "00:00"))],
)
DEATH = csv("person_id,death_date,death_datetime", [(105, day(15), day(15, "03:00")), (120, day(30), day(30, "16:00"))])
CONCEPT = csv("concept_id,concept_name", [(8001, "Dose level"), (8002, "Ward note")])
RELATION = csv("concept_id_1,concept_id_2,relationship_id", [(8001, 501, "Maps to"), (501, 8001, "Mapped from"), (502, 8002, "Mapped from")])


def measurements():
    """Dose levels (501) twice on the first day and once on the third; notes (502) without a number on the second."""
    rows = []
    for p, d, level in WARD:
        for n, clock, concept, value in ((0, "09:30", 501, level), (0, "21:15", 501, level + 3), (2, "06:00", 501, 2 * level), (1, "10:00", 502, "")):
            rows.append((len(rows) + 1, p, concept, day(d + n), day(d + n, clock), value, *((41, "ml", f"0{p}") if concept == 501 else ("", "", "007"))))
    return csv("measurement_id,person_id,measurement_concept_id,measurement_date,measurement_datetime,value_as_number,unit_concept_id,unit_source_value,measurement_source_value", rows)


def drugs():
    """601 from the second to the fourth day, 602 from before the period to its second day."""
    rows = []
    for p, d, _ in WARD:
        for concept, a, b, days in ((601, 1, 3, 6), (602, -2, 1, 2)):
            rows.append((len(rows) + 1, p, concept, day(d + a), day(d + a, "08:00"), day(d + b), day(d + b, "20:00"), days))
    return csv("drug_exposure_id,person_id,drug_concept_id,drug_exposure_start_date,drug_exposure_start_datetime,drug_exposure_end_date,drug_exposure_end_datetime,days_supply", rows)


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("omop")
    files = {"person": PERSON, "observation_period": PERIOD, "visit_occurrence": VISIT, "death": DEATH, "concept": CONCEPT, "concept_relationship": RELATION, "MEASUREMENT": measurements(), "drug_exposure": drugs(), "observation": "observation_id,person_id,observation_concept_id,observation_date,observation_datetime,value_as_number\n", "unknown": "a\n1\n", "download_verification_tag": ""}
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(("﻿" if name == "person" else "") + text)
    (folder / "specimen.xlsx").write_text("x")
    return omop.setup_connection(spark, str(folder))


def values(cube, layer="X"):
    out = {}
    for r in to_long(cube, layer).collect():
        out[(int(r["observation_id"]), int(r["variable"]), int(r["time"]))] = r["value"]
    return out


def line(cube, obs, concept, steps=4):
    got = values(cube)
    return [got[obs, concept, t] for t in range(steps)]


def extract(catalog, table="person_observation_period", **more):
    options = dict(data_tables=["measurement"], data_field_to_keep=["value_as_number"], interval_length_number=1, interval_length_unit="day", num_intervals=4) | more
    return omop.setup_variables(omop.setup_obs(catalog, table), catalog, **options)


def spans(catalog, **more):
    options = dict(data_tables=["drug_exposure"], data_field_to_keep=["days_supply"], interval_length_number=1, interval_length_unit="day", num_intervals=4) | more
    return omop.setup_interval_variables(omop.setup_obs(catalog, "person_observation_period"), catalog, **options)


def test_catalog(catalog):
    assert "measurement" in catalog and "unknown" not in catalog and "specimen" not in catalog
    kinds = dict(catalog["measurement"].dtypes)
    assert kinds["measurement_date"] == "date" and kinds["measurement_datetime"] == "timestamp_ntz"
    assert catalog["measurement"].where("measurement_source_value = '007'").count() == 4
    assert catalog["person"].columns[0] == "person_id"


@pytest.mark.parametrize(("table", "rows"), [("person", 5), ("person_observation_period", 4), ("person_visit_occurrence", 3)])
def test_observations(catalog, table, rows):
    cube = omop.setup_obs(catalog, table, death_table=True)
    assert cube.shape == (rows, 0, 1)
    assert [r[0] for r in cube.obs.orderBy("obs_idx").select("obs_name").collect()] == [str(k) for k in range(rows)]
    assert "death_datetime" in cube.obs.columns


@pytest.mark.parametrize("precision", ["date", "datetime"])
def test_last_value_of_a_day(catalog, precision):
    cube = extract(catalog, time_precision=precision)
    for obs, (_, _, level) in enumerate(WARD):
        assert line(cube, obs, 501) == [level + 3, None, 2 * level, None]
        assert line(cube, obs, 502) == [None] * 4


@pytest.mark.parametrize(("strategy", "first", "third"), [("first", 9, 18), ("mean", 10.5, 18), ("median", 10.5, 18), ("sum", 21, 18), ("min", 9, 18), ("max", 12, 18), ("count", 2, 1), ("std", math.sqrt(4.5), None), ("mode", 9, 18)])
def test_strategies(catalog, strategy, first, third):
    cube = extract(catalog, aggregation_strategy=strategy)
    empty = 0 if strategy == "count" else None
    got = line(cube, 1, 501)
    assert got[0] == pytest.approx(first) and got[1:] == [empty, third, empty]


def test_presence_and_order(catalog):
    cube = extract(catalog, data_field_to_keep=["is_present"])
    assert line(cube, 2, 502) == [None, 1, None, None]
    assert [r[0] for r in cube.var.orderBy("var_idx").select("var_name").collect()] == ["501", "502"]


def test_hours_of_visits(catalog):
    """Visits by their ids: 66 and 71 of one person, 68 of one without readings in it."""
    cube = extract(catalog, "person_visit_occurrence", interval_length_unit="h", num_intervals=24)
    for obs, levels in enumerate(({6: 18}, {}, {1: 9, 13: 12})):
        assert {k: v for k, v in enumerate(line(cube, obs, 501, 24)) if v is not None} == levels


@pytest.mark.parametrize(("keep", "early", "late"), [("start", [None, 6, None, None], [None] * 4), ("end", [None, None, None, 6], [None, 2, None, None]), ("interval", [None, 6, 6, 6], [2, 2, None, None])])
@pytest.mark.parametrize("precision", ["date", "datetime"])
def test_spans(catalog, keep, early, late, precision):
    cube = spans(catalog, keep_date=keep, time_precision=precision)
    assert line(cube, 1, 601) == early and line(cube, 1, 602) == late


def test_enrichment(catalog):
    cube = extract(catalog, enrich_var_with_feature_info=True, enrich_var_with_unit_info=True)
    got = {r["data_table_concept_id"]: r for r in cube.var.collect()}
    assert got[501]["concept_name"] == "Dose level" and got[501]["unit_concept_id"] == 41
    report = cube.uns["unit_report_measurement"].orderBy("concept_id").collect()
    assert [r["unit_concept_id"] for r in report] == [41, None] and not any(r["multiple_units"] for r in report)


def test_concepts_stacking_and_empty_tables(catalog):
    assert extract(catalog, concept_ids=[501]).n_vars == 1
    cube = omop.setup_variables(omop.setup_obs(catalog, "person_observation_period"), catalog, data_tables=["measurement", "observation"], data_field_to_keep={"measurement": "value_as_number", "observation": "value_as_number"}, interval_length_number=1, interval_length_unit="day", num_intervals=2)
    assert cube.shape == (4, 2, 2)
    same = omop.setup_obs(catalog, "person_observation_period")
    assert omop.setup_variables(same, catalog, data_tables="observation", data_field_to_keep="value_as_number", interval_length_number=1, interval_length_unit="day", num_intervals=2) is same


@pytest.mark.parametrize(
    ("more", "error", "text"),
    [
        ({"data_tables": 1}, TypeError, "Expected data_tables to be a string or Sequence."),
        ({"data_tables": ["x"]}, ValueError, "data_tables must be a subset of"),
        ({"data_tables": ["measurement", "observation"]}, TypeError, "must be a dictionary"),
        ({"data_field_to_keep": {"x": "y"}}, ValueError, "keys must be equal to data_tables"),
        ({"data_field_to_keep": 3}, TypeError, "Expected data_field_to_keep to be"),
        ({"interval_length_number": "1"}, TypeError, "Expected interval_length_number to be an integer."),
        ({"interval_length_unit": 1}, TypeError, "Expected interval_length_unit to be a string."),
        ({"interval_length_unit": "month"}, ValueError, "fixed length"),
        ({"num_intervals": "4"}, TypeError, "Expected num_intervals to be an integer."),
        ({"concept_ids": 3}, TypeError, "concept_ids must be a sequence"),
        ({"aggregation_strategy": "x"}, TypeError, "aggregation_strategy must be one of"),
        ({"time_precision": 1}, TypeError, "Expected time_precision to be a string."),
        ({"time_precision": "year"}, ValueError, "time_precision must be one of"),
        ({"enrich_var_with_unit_info": 1}, TypeError, "to be a boolean"),
    ],
)
def test_arguments(catalog, more, error, text):
    with pytest.raises(error, match=text):
        extract(catalog, **more)


def test_observation_arguments(catalog):
    with pytest.raises(ValueError, match="observation_table must be one of"):
        omop.setup_obs(catalog, "x")
    with pytest.raises(TypeError, match="Expected catalog"):
        omop.setup_obs({}, "person")
    with pytest.raises(TypeError, match="Expected observation_table"):
        omop.setup_obs(catalog, 1)
    with pytest.raises(TypeError, match="Expected death_table"):
        omop.setup_obs(catalog, "person", death_table=1)
    with pytest.raises(ValueError, match="birth_datetime"):
        extract(catalog, "person")


@pytest.mark.parametrize(("unit", "precision", "warns"), [("hour", "date", True), ("ms", "date", True), ("day", "date", False), ("hour", "datetime", False)])
def test_precision_warning(catalog, unit, precision, warns, caplog):
    extract(catalog, interval_length_unit=unit, time_precision=precision, num_intervals=2)
    assert ("Using interval_length_unit" in caplog.text) == warns


def test_a_person_with_many_overlapping_observations(spark):
    """Each event meets only the observations around it, and the bins are those of all pairs."""
    from pyspark.sql import functions as F

    from chronolake.operators.binning import binned

    hour = 3_600_000_000
    at = lambda h: F.lit("2031-03-04 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=h)
    obs = spark.range(1000).select(F.col("id").alias("obs_id"), F.lit(1).alias("person_id"), at((F.col("id") * 3).cast("int")).alias("start_date"), F.lit(None).cast("timestamp_ntz").alias("end_date"))
    events = spark.range(3000).select(F.lit(1).alias("person_id"), F.lit("c").alias("concept"), at((F.col("id") * 7 % 3100 - 20).cast("int")).alias("at"), F.col("id").alias("value"))
    got = binned(obs, events, length=2 * hour, count=5, fields=["value"], strategy="count")
    want = {}
    for o in range(1000):
        for e in range(3000):
            gap = e * 7 % 3100 - 20 - 3 * o
            if 0 <= gap < 10:
                want[o, gap // 2] = want.get((o, gap // 2), 0) + 1
    assert {(r["obs_id"], r["interval_step"]): r["value"] for r in got.collect()} == want
    joined = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert len(joined) == 1 and "_stretch" in joined[0]
