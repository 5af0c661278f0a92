"""Cubes, reshaping, feature types, moves, storage, loaders and streams on small data."""

import json
import shutil
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import chronolake as cl
from chronolake.functions.bins import closed_step, covered_steps, point_step
from chronolake.operators.cube import Cube, Layer, default_tem
from chronolake.operators.export import packed, time_slice
from chronolake.operators.reshape import from_frame, to_frame
from chronolake.sources import store
from chronolake.sources.loaders import challenge_cube, read_csv
from chronolake.sources.store import load, save, vacuum, versions
from chronolake.sources.synthetic import blobs


@pytest.fixture(scope="module")
def cube(spark):
    obs = spark.createDataFrame([(k, f"obs{k + 1}", k + 1, "aac"[k]) for k in range(3)], "obs_idx int, obs_name string, obs_col_1 int, obs_col_2 string")
    var = spark.createDataFrame([(k, f"var{k + 1}") for k in range(3)], "var_idx int, var_name string")
    tem = spark.createDataFrame([(k, f"t{k + 1}") for k in range(3)], "t_idx int, tem_name string")
    deep = spark.createDataFrame([(o, v, t, float(9 * o + 3 * v + t + 1)) for o in range(3) for v in range(3) for t in range(3)], "obs_idx int, var_idx int, t_idx int, value double")
    flat = spark.createDataFrame([(o, v, float(3 * o + v + 1)) for o in range(3) for v in range(3)], "obs_idx int, var_idx int, value double")
    return Cube.build(obs, var, tem, {"X": Layer(flat, 2), "tem_data": Layer(deep, 3)})


def array(c, layer="tem_data"):
    out = np.full(c.shape if c.layers[layer].ndim == 3 else c.shape[:2], np.nan)
    for r in c.layers[layer].cells.collect():
        out[tuple(r)[:-1]] = r["value"]
    return out


FULL = np.arange(1, 28).reshape(3, 3, 3)
KEYS = [slice(0, 2), slice(None), 1, -1, [0, 2], [True, False, True], slice(0, 3, 2)]


@pytest.mark.parametrize("o", KEYS[:5])
@pytest.mark.parametrize("t", [KEYS[0], KEYS[2], KEYS[5]])
def test_slices(cube, o, t):
    take = lambda k: np.arange(3)[k] if not isinstance(k, int) else np.arange(3)[[k]]
    got = cube[o, ["var3", "var1"], t]
    assert np.array_equal(array(got), FULL[np.ix_(take(o), [2, 0], take(t))])
    assert np.array_equal(array(got, "X"), np.arange(1, 10).reshape(3, 3)[np.ix_(take(o), [2, 0])])


def test_slices_compose(cube):
    got = cube[1:][:, [0, 2]].sel(obs=F.col("obs_col_2") == "c")[:, :, 1]
    assert np.array_equal(array(got), FULL[2:3][:, [0, 2]][:, :, 1:2]) and got.shape == (1, 2, 1)
    assert np.array_equal(array(cube[[2, 0, 2]]), FULL[[2, 0, 2]])
    with pytest.raises(KeyError):
        cube[["nobody"]]
    with pytest.raises(IndexError):
        cube[0, 0, 0, 0]
    with pytest.raises(IndexError):
        cube[5]


def test_repr(cube):
    text = "Cube object with n_obs × n_vars × n_t = 3 × 3 × 3\n    obs: 'obs_col_1', 'obs_col_2'\n    tem: 't1', 't2', 't3'\n    layers: 'tem_data'\n    shape of .X: (3, 3)\n    shape of .tem_data: (3, 3, 3)"
    assert repr(cube) == text
    assert repr(cube[:2, :2, :2]).startswith("View of Cube object with n_obs × n_vars × n_t = 2 × 2 × 2")


def test_axis_rules(spark, cube):
    flat = Cube.build(cube.obs, cube.var, None, {"X": cube.X})
    assert flat.shape == (3, 3, 1)
    assert flat.with_tem(cube.tem).n_t == 3
    grown = flat.with_layer("deep", cube.layers["tem_data"].cells)
    assert grown.n_t == 3 and [r[1] for r in grown.tem.orderBy("t_idx").collect()] == ["0", "1", "2"]
    with pytest.raises(ValueError):
        cube.with_tem(default_tem(spark, 5))
    with pytest.raises(ValueError):
        cube.with_layer("y", cube.layers["tem_data"].cells.where("t_idx < 2"))
    with pytest.raises(ValueError):
        flat.with_tem("x")


def test_reduce_and_export(cube):
    assert np.array_equal(array(cube.reduce_time("tem_data", "max", to="m"), "m"), FULL.max(2))
    assert np.array_equal(array(time_slice(cube, "tem_data", -1), "X"), FULL[:, :, 2])
    got = {r[0]: np.array(r[1]) for r in packed(cube, "tem_data").collect()}
    assert all(np.array_equal(got[k], FULL[k]) for k in range(3))


def test_wide_and_long_round_trip(cube):
    wide = to_frame(cube, layer="tem_data", obs_cols=["obs_col_1"])
    assert wide.columns[1:4] == ["var1_t_t1", "var1_t_t2", "var1_t_t3"] and wide.columns[-1] == "obs_col_1"
    back = from_frame(wide, format="wide", index_column="obs_name", columns_obs_only=["obs_col_1"])
    assert back.shape == (3, 3, 3) and np.array_equal(np.sort(array(back, "X").ravel()), FULL.ravel())
    long = to_frame(cube, layer="tem_data", format="long")
    assert long.count() == 27 and long.columns == ["observation_id", "variable", "time", "value"]
    assert np.array_equal(array(from_frame(long, format="long"), "X"), FULL)
    with pytest.raises(NotImplementedError):
        to_frame(cube, format="long", obs_cols=["obs_col_1"])


def test_frame_errors(spark):
    df = spark.createDataFrame([("p", 1)], "id string, a int")
    for options, error in (({"format": "x"}, ValueError), ({"index_column": "z"}, ValueError), ({"index_column": 7}, IndexError), ({"format": "wide"}, ValueError), ({"format": "long", "index_column": "id"}, ValueError), ({"fill_time_gaps": True}, ValueError), ({"columns_obs_only": ["q"]}, ValueError)):
        with pytest.raises(error):
            from_frame(df, **options)
    twice = spark.createDataFrame([("p", "v", 0, 1.0), ("p", "v", 0, 2.0)], "observation_id string, variable string, time int, value double")
    with pytest.raises(ValueError):
        from_frame(twice, format="long")


def test_long_with_gaps_and_statics(spark):
    rows = [("p2", "v", 0, 1.0), ("p1", "v", 2, 2.0), ("p1", "age", 0, 40.0)]
    c = from_frame(spark.createDataFrame(rows, "observation_id string, variable string, time long, value double"), format="long", fill_time_gaps=True, columns_obs_only=["age"])
    assert c.shape == (2, 1, 3)
    assert {(r["obs_name"], r["age"]) for r in c.obs.collect()} == {("p1", 40.0), ("p2", None)}


SAMPLES = {
    "int": (["1", "2", "3", None], "numeric"), "float": (["1.5", "2", "-3e2", "7"], "numeric"), "binary": (["0", "1", "0", "1"], "categorical"),
    "text": (["a", "b", "a", None], "categorical"), "mixed": (["1", "E10", "2", "3"], "categorical"), "day": (["2020-01-01", "2021-12-31", None, "2020-02-02"], "date"),
    "basic": (["2020-01-01T10:00:00", "20200101", "2020-W01", None], "date"),
}


def test_feature_types(spark):
    rows = [(o, v, x) for v, (xs, _) in enumerate(SAMPLES.values()) for o, x in enumerate(xs)]
    cells = spark.createDataFrame(rows, "obs_idx int, var_idx int, value string")
    var = spark.createDataFrame(list(enumerate(SAMPLES)), "var_idx int, var_name string")
    obs = spark.createDataFrame([(k, str(k)) for k in range(4)], "obs_idx int, obs_name string")
    c = cl.infer_feature_types(Cube.build(obs, var, None, {"X": Layer(cells, 2)}, n_t=1))
    assert {r["var_name"]: r["feature_type"] for r in c.var.collect()} == {k: t for k, (_, t) in SAMPLES.items()}
    fixed = cl.replace_feature_types(c, "binary", "numeric")
    assert cl.infer_feature_types(fixed).var.where("var_name = 'binary' AND feature_type = 'numeric'").count() == 1
    assert cl.feature_type_overview(c).where("var_name = 'text'").first()["categories"] == 2
    with pytest.raises(KeyError):
        cl.replace_feature_types(c, "nothing", "date")
    with pytest.raises(ValueError):
        cl.replace_feature_types(c, "int", "x")
    empty = Cube.build(obs, var, None, {"X": Layer(cells.where("var_idx > 0"), 2)}, n_t=1)
    with pytest.raises(ValueError, match="int"):
        cl.infer_feature_types(empty)


def test_moves(cube):
    flat = time_slice(cube, "tem_data", 0)
    moved = cl.move_to_obs(flat, ["var2"])
    assert moved.shape == (3, 2, 1) and [r["var2"] for r in moved.obs.orderBy("obs_idx").collect()] == [4.0, 13.0, 22.0]
    back = cl.move_to_x(moved, ["var2"])
    assert np.array_equal(array(back, "X"), FULL[:, [0, 2, 1], 0])
    assert cl.move_to_obs(flat, "var1", copy_columns=True).n_vars == 3
    with pytest.raises(ValueError):
        cl.move_to_obs(cube, "var1", layer="tem_data")
    with pytest.raises(ValueError):
        cl.move_to_obs(flat, "q")


def test_store(spark, cube, tmp_path):
    save(cube.with_layer("filled", cube.layers["tem_data"].cells.where("value > 20"), depth=3, fill=9.0), str(tmp_path / "c"))
    back = load(spark, str(tmp_path / "c"))
    assert back.shape == cube.shape and np.array_equal(array(back), FULL) and back.layers["filled"].fill == 9.0
    assert back.dense("filled").where("value = 9").count() == 20
    bad = cube.with_layer("bad", cube.X.cells.withColumn("value", F.array("value")), ndim=2)
    with pytest.raises(ValueError):
        save(bad, str(tmp_path / "d"))


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("patient_id,los,name\n7,1,x\n8,np.nan,y\n")
    c = read_csv(spark, str(tmp_path / "a.csv"), index_column="patient_id", columns_obs_only=["name"])
    assert c.shape == (2, 1, 1) and [r[0] for r in c.obs.orderBy("obs_idx").select("obs_name").collect()] == ["7", "8"]
    assert cl.harmonize_missing_values(c).X.cells.where("value IS NOT NULL").count() == 1


def test_challenge(spark):
    rows = spark.createDataFrame([("a", "HR", 0.0, 1.0, 0), ("a", "HR", 1.0, 2.0, 1), ("a", "HR", 1.5, 3.0, 2), ("b", "HR", 2.0, -1.0, 3), ("b", "HR", 9.0, 5.0, 4)], "record string, parameter string, hours double, value double, position long")
    obs = spark.createDataFrame([("a",), ("b",), ("c",)], "record string")
    c = challenge_cube(rows, obs, ["HR", "BP"], count=2, drop=["c"], null_if={"HR": -1.0})
    assert c.shape == (2, 2, 2) and {tuple(r) for r in c.layers["tem_data"].cells.collect()} == {(0, 0, 0, 2.0), (0, 0, 1, 3.0)}


def test_generator(spark):
    c = blobs(spark, n_observations=20, n_variables=4, n_timepoints=5, missing=0.2, n_categorical=1, seed=3)
    again = blobs(spark, n_observations=20, n_variables=4, n_timepoints=5, missing=0.2, n_categorical=1, seed=3)
    assert c.shape == (20, 4, 5) and sorted(map(tuple, c.layers["tem_data"].cells.collect())) == sorted(map(tuple, again.layers["tem_data"].cells.collect()))
    assert 200 < c.layers["tem_data"].cells.count() < 400


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-50, 50), st.one_of(st.none(), st.integers(-50, 50))), min_size=1, max_size=20))
def test_steps_equal_ranges(spark, pairs):
    """Span steps equal the overlap conditions written out, ends on boundaries included."""
    length, count = 10, 3
    rows = spark.createDataFrame(list(enumerate(pairs)), "id int, p struct<a:int,b:int>").select("id", *[F.timestamp_add("MINUTE", F.col(f"p.{c}"), F.lit("2020-01-01").cast("timestamp_ntz")).alias(c) for c in "ab"])
    zero = F.lit("2020-01-01").cast("timestamp_ntz")
    minutes = length * 60_000_000
    got = {r["id"]: (r["step"], sorted(r["steps"])) for r in rows.select("id", point_step(zero, F.col("a"), minutes).alias("step"), covered_steps(zero, F.col("a"), F.col("b"), minutes, count).alias("steps")).collect()}
    for k, (a, b) in enumerate(pairs):
        inside = lambda x, i: x is not None and 10 * i <= x < 10 * i + 10
        want = [i for i in range(count) if inside(a, i) or inside(b, i) or (b is not None and a < 10 * i and b >= 10 * i + 10)]
        assert got[k] == (a // 10, want)


def test_right_closed(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 1.1, 2.0, 2.5)], "t double")
    assert [r[0] for r in rows.select(closed_step(F.col("t"), 1.0)).collect()] == [0, 0, 0, 1, 1, 2]


def test_stream(spark, tmp_path):
    from chronolake.streaming.bins import stream_binned

    events = spark.createDataFrame([(k, 1, "hr", float(k), f"2024-01-01 {k:02d}:30:00") for k in range(6)] + [(9, 1, "hr", 9.0, "2024-01-03 00:00:00")], "event_id int, person_id int, concept string, value double, at string").withColumn("at", F.col("at").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    obs = spark.createDataFrame([(1, 1, "2024-01-01")], "obs_id int, person_id int, start_date string")
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = stream_binned(stream, obs, seconds=7200, count=12).writeStream.outputMode("append").format("memory").queryName("bins").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r["interval_step"], r["value"], r["n_events"]) for r in spark.table("bins").collect()} == {(0, 1.0, 2), (1, 3.0, 2), (2, 5.0, 2)}


def test_overview_prints_all_names(spark, capsys):
    var = spark.createDataFrame([(k, f"v{k:03}", "numeric") for k in range(120)], "var_idx int, var_name string, feature_type string")
    obs = spark.createDataFrame([(0, "a")], "obs_idx int, obs_name string")
    cells = spark.createDataFrame([(0, k, 1.0) for k in range(120)], "obs_idx int, var_idx int, value double")
    cl.feature_type_overview(Cube.build(obs, var, None, {"X": Layer(cells, 2)}))
    assert [line.strip() for line in capsys.readouterr().out.splitlines() if line.startswith("  ")] == [f"v{k:03}" for k in range(120)]


def _cells(cube, layer="tem_data"):
    return {tuple(r) for r in cube.layers[layer].cells.collect()}


@pytest.mark.parametrize("flags", [[True, False, True], np.array([True, False, True]), "series"])
def test_masks_on_all_axes(cube, flags):
    import pandas as pd

    flags = pd.Series([True, False, True]) if isinstance(flags, str) else flags
    want = {(o, v, t, 9.0 * (0, 2)[o] + 3 * (0, 2)[v] + (0, 2)[t] + 1) for o in range(2) for v in range(2) for t in range(2)}
    got = cube[flags, flags, flags]
    assert got.shape == (2, 2, 2) and _cells(got) == want
    assert [r[0] for r in got.tem.orderBy("t_idx").select("tem_name").collect()] == ["t1", "t3"]
    with pytest.raises(IndexError):
        cube[[True, False]]


def test_numpy_and_label_keys(cube):
    assert cube[np.int64(1), :, np.array([2, 0])].shape == (1, 3, 2)
    assert _cells(cube[np.array([2, 2, 0])][:, ["var1"], 0]) == {(0, 0, 0, 19.0), (1, 0, 0, 19.0), (2, 0, 0, 1.0)}
    assert _cells(cube["obs2":"obs3", "var2":, :"t1"]) == {(o, v, 0, 9.0 * (o + 1) + 3 * (v + 1) + 1) for o in range(2) for v in range(2)}
    assert _cells(cube[::-2, :1, ::-1]) == {(o, 0, t, 9.0 * (2, 0)[o] + (2 - t) + 1) for o in range(2) for t in range(3)}
    assert cube[[]].shape == (0, 3, 3) and cube[3:].shape == (0, 3, 3)
    with pytest.raises(KeyError):
        cube["obs2":"nobody"]
    with pytest.raises(IndexError):
        cube[[0, 1.5]]


def test_slices_neither_sort_nor_join(cube):
    got = cube[1:, ["var3", "var1"], ::2]
    for frame in (got.layers["tem_data"].cells, got.obs, got.var):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and "Sort" not in plan
    assert got.shape == (2, 2, 2)


def test_long_lists_are_joined(cube, monkeypatch):
    from chronolake.operators import cube as module

    want = _cells(cube[[2, 0]])
    monkeypatch.setattr(module, "LITERALS", 1)
    assert _cells(cube[[2, 0]]) == want
    monkeypatch.setattr(module, "ARRAYS", 1)
    assert {tuple(r) for r in cube.dense("tem_data").select("obs_idx", "var_idx", "t_idx", "value").collect()} == _cells(cube)


def test_dense_and_packed_layers(cube, spark):
    sparse = spark.createDataFrame([(0, 1, 2, 5.0), (2, 0, 0, 7.0)], "obs_idx int, var_idx int, t_idx int, value double")
    c = cube.with_layer("s", sparse, depth=3, fill=0.0).with_layer("f", sparse.where("t_idx = 0").drop("t_idx"), ndim=2)
    dense = {tuple(r) for r in c.dense("s").select("obs_idx", "var_idx", "t_idx", "value").collect()}
    assert len(dense) == 27 and {x for x in dense if x[3]} == {tuple(r) for r in sparse.collect()}
    assert {r["obs_idx"]: r["features"] for r in packed(c, "s").collect()}[0] == [[0.0] * 3, [0.0, 0.0, 5.0], [0.0] * 3]
    flat = {r["obs_idx"]: r["rows"] for r in c.rows("f").collect()}
    assert flat == {0: [None] * 3, 1: [None] * 3, 2: [7.0, None, None]}
    deep = {r["obs_idx"]: r["rows"] for r in c.rows("s").collect()}
    assert deep[1] == [[None] * 3] * 3


def test_feature_types_output(cube, caplog):
    with pytest.raises(ValueError):
        cl.infer_feature_types(cube, output="list")
    got = cl.infer_feature_types(cube, output="dataframe")
    assert got.columns == ["var_name", "feature_type"] and got.count() == 3
    with pytest.warns(UserWarning, match="tem_data"):
        cl.infer_feature_types(Cube(cube.obs, cube.var, cube.tem, {"tem_data": cube.layers["tem_data"]}, 3, 3, 3))


def test_frames_and_moves_refuse_what_does_not_fit(cube, spark):
    frame = spark.createDataFrame([(1, "a", 0, 2.0)], "id int, what string, at int, number double")
    keys = {"observation_column": "id", "variable_column": "what", "time_column": "at", "value_column": "number"}
    assert from_frame(frame, format="long", long_format_keys=keys).shape == (1, 1, 1)
    for more in ({"long_format_keys": keys}, {"wide_format_time_suffix": "_t_"}, {"format": "long", "long_format_keys": {"x": "id"}}):
        with pytest.raises(ValueError):
            from_frame(frame, **more)
    with pytest.raises(ValueError, match="two axes"):
        cl.move_to_x(cube, "obs_col_1", layer="tem_data")


def test_store_keeps_the_old_cube_until_the_new_one_is_there(cube, tmp_path):
    path = str(tmp_path / "cube")
    save(cube, path)
    with pytest.raises(FileExistsError):
        save(cube, path)
    one = Cube(cube.obs, cube.var, cube.tem, {"X": cube.X}, 3, 3, 3)
    save(one, path, mode="overwrite")
    assert set(load(cube.obs.sparkSession, path).layers) == {"X"} and len([p for p in (tmp_path / "cube").iterdir() if p.name.startswith("data-")]) == 2
    assert len(vacuum(cube.obs.sparkSession, path)) == 1
    bad = Cube(cube.obs, cube.var, cube.tem, {"X": Layer(cube.X.cells.withColumn("value", F.array("value")), 2)}, 3, 3, 3)
    with pytest.raises(ValueError):
        save(bad, path, mode="overwrite")
    assert _cells(load(cube.obs.sparkSession, path), "X") == _cells(cube, "X")


def test_store_versions(spark, cube, tmp_path, monkeypatch):
    """Readers hold their version; of two saves from one version one wins; vacuum keeps the last versions; older formats are read."""
    path, one = str(tmp_path / "cube"), Cube(cube.obs, cube.var, cube.tem, {"X": cube.X}, 3, 3, 3)
    assert save(cube, path) == 1
    reader = load(spark, path)
    assert save(one, path, mode="overwrite") == 2 and versions(spark, path) == [1, 2]
    assert _cells(reader, "tem_data") == _cells(cube, "tem_data")
    assert set(load(spark, path).layers) == {"X"} and set(load(spark, path, version=1).layers) == set(cube.layers)
    monkeypatch.setattr(store, "_next", lambda spark, path: 2)  # began before version 2 was made
    with pytest.raises(store.Conflict):
        save(cube, path, mode="overwrite")
    monkeypatch.undo()
    assert set(load(spark, path).layers) == {"X"}
    with pytest.raises(ValueError, match="no version"):
        load(spark, path, version=7)
    (tmp_path / "cube" / "_versions" / "0000000003.claim").touch()  # a save that died after its claim
    assert save(one, path, mode="overwrite") == 4
    assert len(vacuum(spark, path, keep=2)) == 2 and versions(spark, path) == [2, 4]
    manifest = next((tmp_path / "cube" / "_versions").glob("*4.json"))
    old = json.loads(manifest.read_text()) | {"format_version": 2}
    (tmp_path / "cube" / "manifest").mkdir()
    (tmp_path / "cube" / "manifest" / "part-0").write_text(json.dumps(old))
    shutil.rmtree(tmp_path / "cube" / "_versions")
    assert _cells(load(spark, path), "X") == _cells(cube, "X")
    (tmp_path / "cube" / "manifest" / "part-0").write_text(json.dumps(old | {"format_version": 9}))
    with pytest.raises(ValueError, match="newer"):
        load(spark, path)


def test_store_tiles(spark, tmp_path):
    """Slices open the files whose boxes they touch, on every axis, and give what they gave before."""
    obs, var = (spark.range(n).select(F.col("id").cast("int").alias(f"{a}_idx"), F.col("id").cast("string").alias(f"{a}_name")) for a, n in (("obs", 64), ("var", 16)))
    rows = spark.range(64 * 16 * 16).select(*((F.shiftright("id", s) % n).cast("int").alias(c) for c, s, n in (("obs_idx", 8, 64), ("var_idx", 4, 16), ("t_idx", 0, 16))), F.col("id").cast("double").alias("value"))
    big = Cube.build(obs, var, None, {"X": Layer(rows, 3)}, n_t=16)
    save(big, str(tmp_path / "big"), cells_per_file=256)
    back = load(spark, str(tmp_path / "big"))
    many = len(back.X.cells.inputFiles())
    assert many >= 64
    for pick, share in ((lambda c: c[:, 3, 5], 0.15), (lambda c: c[7], 0.2), (lambda c: c[:, :, 4:6], 0.4), (lambda c: c[10:20][:, [2, 3]][:, :, -1], 0.15), (lambda c: c[[0, 63], 0, 0], 0.06), (lambda c: c[:], 1)):
        assert key_rows(pick(back).X.cells) == key_rows(pick(big).X.cells)
        assert len(pick(back).X.cells.inputFiles()) <= many * share
    assert back[[]].X.cells.count() == 0
    text = replace(big, layers={"X": Layer(rows.withColumn("value", F.col("value").cast("string")), 3)})
    save(text, str(tmp_path / "text"), cells_per_file=256)
    assert key_rows(load(spark, str(tmp_path / "text"))[5, :, 2].X.cells) == key_rows(big[5, :, 2].X.cells)


def key_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_generator_options(spark):
    cube = blobs(spark, n_observations=40, n_variables=3, n_timepoints=12, time_shifts=True, irregular=True, variable_length=True, n_categorical=2, n_categories=[2, 4], seed=3)
    got = {r["var_idx"]: (r["low"], r["high"], r["n"]) for r in cube.layers["tem_data"].cells.groupBy("var_idx").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count_distinct("value").alias("n")).collect()}
    assert got[1] == (0.0, 1.0, 2) and got[2] == (0.0, 3.0, 4)
    # the axis is the union of the records' times, in order
    tem = [(r["t_idx"], r["tem_name"], r["time_value"]) for r in cube.tem.orderBy("t_idx").collect()]
    assert cube.n_t == len(tem) and [t[0] for t in tem] == list(range(len(tem))) and [t[2] for t in tem] == sorted({t[2] for t in tem})
    per = cube.layers["tem_data"].cells.where("var_idx = 0").groupBy("obs_idx").agg(F.count("*").alias("n"), F.min("t_idx").alias("first")).collect()
    assert len(per) == 40 and sum(r["n"] for r in per) - 39 == cube.n_t, "irregular times are all different, but for the last one, which ends all"
    assert min(r["n"] for r in per) >= 10 and max(r["n"] for r in per) <= 18 and len({r["n"] for r in per}) > 3
    assert all(0 <= t[2] <= 18 + 1e-9 for t in tem)


def test_generator_unites_times(spark):
    """Regular records without shift share one axis; shifted ones meet where their times are equal; given records keep names and starts."""
    assert blobs(spark, n_observations=30, n_variables=2, n_timepoints=8).n_t == 8
    given = spark.createDataFrame([("b", 0.0, 5), ("a", 2.0, 5), ("c", 0.0, 3), ("d", 7.5, 1), ("e", 1.0, 0)], "obs_name string, start double, steps int")
    cube = blobs(spark, records=given, n_variables=1)
    assert [r["obs_name"] for r in cube.obs.orderBy("obs_idx").collect()] == list("abcde")
    times = {r["t_idx"]: r["time_value"] for r in cube.tem.collect()}
    own = {}
    for r in cube.layers["tem_data"].cells.collect():
        own.setdefault("abcde"[r["obs_idx"]], []).append(times[r["t_idx"]])
    assert {k: sorted(v) for k, v in own.items()} == {"b": [0, 1.25, 2.5, 3.75, 5], "a": [2, 3.25, 4.5, 5.75, 7], "c": [0, 2.5, 5], "d": [7.5]}
    assert sorted(times.values()) == sorted({t for v in own.values() for t in v})
    with pytest.raises(ValueError, match="fewer variables"):
        blobs(spark, n_variables=1, n_categorical=2)


def test_generator_sparsity(spark):
    thin = blobs(spark, n_observations=50, n_variables=4, n_timepoints=10, sparsity=0.9)
    assert thin.layers["tem_data"].fill == 0.0 and 100 < thin.layers["tem_data"].cells.count() < 320


def test_stream_bins_follow_time_zero(spark, tmp_path):
    """A time zero that is no multiple of the length still gives one row for each bin."""
    from chronolake.streaming.bins import stream_binned

    events = spark.createDataFrame([(k, 1, "hr", float(k), f"2024-01-01 {k:02d}:30:00") for k in range(6)] + [(9, 1, "hr", 9.0, "2024-01-03 00:00:00")], "event_id int, person_id int, concept string, value double, at string").withColumn("at", F.col("at").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    obs = spark.createDataFrame([(1, 1, "2024-01-01 00:20:00")], "obs_id int, person_id int, start_date string")
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = stream_binned(stream, obs, seconds=7200, count=12).writeStream.outputMode("append").format("memory").queryName("shifted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r["interval_step"], r["value"], r["n_events"]) for r in spark.table("shifted").collect()} == {(0, 1.0, 2), (1, 3.0, 2), (2, 5.0, 2)}
