"""Loaders of challenge files, packed tensors with labels, and the unit and concept helpers."""

import numpy as np
import pytest

from chronolake import omop
from chronolake.datasets import diabetes_130_raw, mimic_2, mimic_2_preprocessed, mimic_iv_omop, physionet2012, physionet2019
from chronolake.functions.spec import TABLES, microseconds
from chronolake.operators.export import iterate, labelled_tensors, scatter_pair
from chronolake.operators.feed import TensorSet
from chronolake.operators.extraction import remapped, unit_report
from chronolake.functions.spec import EVENT_TABLES
from chronolake.sources.catalog import Catalog, table_name


def test_2012_files(spark, tmp_path):
    (tmp_path / "132539.txt").write_text("Time,Parameter,Value\n00:00,RecordID,132539\n00:00,Age,54\n00:07,HR,73\n00:30,HR,75\n01:00,HR,77\n02:30,HR,60\n")
    (tmp_path / "132540.txt").write_text("Time,Parameter,Value\n00:00,RecordID,132540\n00:00,Age,76\n01:01,HR,-1\n")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "outcomes.csv").write_text("RecordID,In-hospital_death\n132539,0\n132540,1\n")
    cube = physionet2012(spark, str(tmp_path / "*.txt"), str(tmp_path / "out" / "outcomes.csv"), static=("Age",), count=2, null_if={"HR": -1.0})
    assert cube.shape == (2, 1, 2)
    assert {tuple(r) for r in cube.layers["tem_data"].cells.collect()} == {(0, 0, 0, 77.0)}
    assert [(r["record"], r["Age"], r["In-hospital_death"]) for r in cube.obs.orderBy("obs_idx").collect()] == [("132539", 54.0, 0), ("132540", 76.0, 1)]
    first = physionet2012(spark, str(tmp_path / "*.txt"), static=("Age",), count=2, keep="first", drop=["132540"])
    assert {tuple(r) for r in first.layers["tem_data"].cells.collect()} == {(0, 0, 0, 73.0)}


def test_2019_files(spark, tmp_path):
    for name, age in (("p1", 50), ("p2", 60)):
        (tmp_path / f"{name}.psv").write_text(f"HR|O2Sat|Age|ICULOS\n80|NaN|{age}|1\n81|97|{age}|2\n99|99|{age}|9\n")
    cube = physionet2019(spark, str(tmp_path), static=("Age",), count=3)
    assert cube.shape == (2, 2, 3) and [r["Age"] for r in cube.obs.orderBy("obs_idx").collect()] == [50, 60]
    assert {tuple(r) for r in cube.layers["tem_data"].cells.where("obs_idx = 0").collect()} == {(0, 0, 0, 80.0), (0, 0, 1, 81.0), (0, 1, 1, 97.0)}
    assert physionet2019(spark, str(tmp_path), static=("Age",), count=3, n_samples=1).n_obs == 1
    with pytest.raises(ValueError):
        physionet2019(spark, str(tmp_path), n_samples=3)


def test_labels_and_tensors(spark):
    day = "timestamp('2100-01-{:02d} 00:00:00')"
    person = spark.sql("SELECT * FROM VALUES (1, 5), (2, 6) t(person_id, location_id)")
    visit = spark.sql(f"SELECT id AS visit_occurrence_id, p AS person_id, to_date({day.format(1)}) AS visit_start_date, {day.format(1)} AS visit_start_datetime, to_date({day.format(9)}) AS visit_end_date, {day.format(9)} AS visit_end_datetime FROM VALUES (7, 1), (8, 2) t(id, p)")
    death = spark.sql(f"SELECT 1 AS person_id, {day.format(9)} AS death_datetime UNION ALL SELECT 2, {day.format(12)}")
    measurement = spark.sql(f"SELECT id AS measurement_id, p AS person_id, c AS measurement_concept_id, to_date({day.format(2)}) AS measurement_date, {day.format(2)} AS measurement_datetime, v AS value_as_number, u AS unit_concept_id FROM VALUES (1, 1, 30, 1.5, 8), (2, 1, 31, 2.5, 9), (3, 2, 30, 3.5, 9) t(id, p, c, v, u)")
    c = Catalog(spark, {"person": person, "visit_occurrence": visit, "death": death, "measurement": measurement})
    cube = omop.setup_variables(omop.setup_obs(c, "person_visit_occurrence"), c, data_tables=["measurement"], data_field_to_keep=["value_as_number"], interval_length_number=1, interval_length_unit="day", num_intervals=3)
    got = list(iterate(labelled_tensors(cube, c)))
    assert [g[2] for g in got] == [1, 0] and got[0][1].shape == (2, 3) and got[0][1].dtype == np.float32
    assert got[0][1][0, 1] == 1.5 and np.isnan(got[0][1][0, 0]) and np.isnan(got[1][1][1]).all()
    some = TensorSet(labelled_tensors(cube, c))
    assert len(some) == 2 and np.array_equal(some[-1][0], got[1][1], equal_nan=True) and some[0][1] == 1
    with pytest.raises(IndexError):
        some[2]
    with pytest.raises(NotImplementedError):
        labelled_tensors(cube, c, target="age")
    report = {(r["concept_id"], r["unit_concept_id"]): r["multiple_units"] for r in unit_report(c["measurement"], EVENT_TABLES["measurement"]).collect()}
    assert report == {(30, 8): True, (30, 9): True, (31, 9): False}
    assert scatter_pair(cube, "location_id", "person_id").count() == 2
    assert {r["mapped"] for r in remapped(c["measurement"].selectExpr("measurement_concept_id AS concept").distinct(), c).collect()} == {30, 31}


def test_names():
    assert table_name("2b_PERSON.csv.gz", "2b_") == "person" and len(TABLES) >= 38
    assert microseconds(2, "h") == 7_200_000_000 and microseconds(1, "m") == 60_000_000 and microseconds(1, "W") == 7 * microseconds(1, "day")
    with pytest.raises(ValueError):
        microseconds(1, "ns")


def test_named_sets(spark, tmp_path):
    (tmp_path / "cohort.csv").write_text("age,censor_flg\n70,0\n80,1\n")
    cube = mimic_2(spark, str(tmp_path / "cohort.csv"), columns_obs_only=["age"])
    assert [r["value"] for r in cube.X.cells.orderBy("obs_idx").collect()] == [1.0, 0.0] and "age" in cube.obs.columns
    assert mimic_2_preprocessed(spark, str(tmp_path / "cohort.csv")).shape == (2, 2, 1)
    assert diabetes_130_raw(spark, str(tmp_path / "cohort.csv")).n_vars == 2
    (tmp_path / "tables").mkdir()
    (tmp_path / "tables" / "2b_concept.csv").write_text("concept_id,concept_name\n1,x\n")
    assert "concept" in mimic_iv_omop(spark, str(tmp_path / "tables"))
