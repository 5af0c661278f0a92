"""The chunked array store: round trips, pruning, format, failures."""

import json
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.operators.cube import Cube, Layer
from chronolake.sources import chunks

SHAPE = (23, 5, 9)


def cells(spark, kind="double", seed=0, share=0.5, shape=SHAPE):
    rng = random.Random(seed)
    rows = [(*at, rng.randint(1, 100)) for at in np.ndindex(shape) if rng.random() < share]
    names = chunks.INDEXES[: len(shape)]
    return spark.createDataFrame(rows, ", ".join([*(f"{c} int" for c in names), "value int"])).withColumn("value", F.col("value").cast(kind)).repartition(3)


def key(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("kind", ["double", "float", "bigint", "smallint", "boolean"])
@pytest.mark.parametrize("level", [None, 1])
def test_round_trip(spark, tmp_path, kind, level):
    """All types, raw and compressed, with lengths that chunks do not divide."""
    rows = cells(spark, kind)
    fill = None if kind in ("double", "float") else 0
    chunks.write_array(rows, f"{tmp_path}/a", SHAPE, chunks=(4, 2, 5), fill=fill, level=level)
    got = chunks.read_array(spark, f"{tmp_path}/a")
    assert got.dtypes[-1] == ("value", kind)
    assert key(got) == key(rows)
    meta = json.load(open(tmp_path / "a/.zarray"))
    assert (meta["zarr_format"], meta["shape"], meta["chunks"]) == (2, list(SHAPE), [4, 2, 5])
    # the format, read without the library
    data = open(tmp_path / "a/5.2.1", "rb").read()
    box = np.frombuffer(zlib.decompress(data) if level else data, meta["dtype"]).reshape(4, 2, 5)
    want = {tuple(r)[:3]: r["value"] for r in rows.where("obs_idx >= 20 AND var_idx >= 4 AND t_idx >= 5").collect()}
    assert {(20 + i, 4 + j, 5 + k): v for (i, j, k), v in np.ndenumerate(box) if v == v and (kind[0] in "df" or v != 0)} == want


@pytest.mark.parametrize(("within", "opened"), [
    ({"obs_idx": [9]}, 6), ({"obs_idx": range(8, 12)}, 6), ({"var_idx": [4]}, 12), ({"t_idx": [1, 2]}, 18), ({"obs_idx": [3], "var_idx": [1], "t_idx": [7]}, 1),
    ({"obs_idx": [0, 22], "t_idx": range(4, -1, -1)}, 6), ({}, 36), ({"obs_idx": range(0, 23, 2)}, 36), ({"obs_idx": range(3, 20, 8)}, 18), ({"t_idx": []}, 0),
])
def test_a_box_opens_the_chunks_it_needs(spark, tmp_path, monkeypatch, within, opened):
    """One partition for each chunk, so that partitions tell how many are opened."""
    monkeypatch.setattr(chunks, "PARTITION", 1)
    rows = cells(spark, share=1)
    chunks.write_array(rows, f"{tmp_path}/a", SHAPE, chunks=(4, 2, 5))
    got = chunks.read_array(spark, f"{tmp_path}/a", within)
    want = rows
    for k, v in within.items():
        want = want.where(F.col(k).isin(list(v)))
    assert key(got) == key(want)
    assert got.rdd.getNumPartitions() == max(opened, 1)
    files = set(os.listdir(tmp_path / "a"))
    assert len(files - {".zarray"}) == 6 * 3 * 2, "no file is left over"


def test_slices_of_a_stored_cube_read_their_chunks(spark, tmp_path, monkeypatch):
    """Slices one after another on all axes, twice on one, and several of one cube in a query."""
    monkeypatch.setattr(chunks, "PARTITION", 1)
    obs, var = (spark.range(n).select(F.col("id").cast("int").alias(f"{a}_idx"), F.col("id").cast("string").alias(f"{a}_name")) for a, n in (("obs", 23), ("var", 5)))
    cube = Cube.build(obs, var, None, {"X": Layer(cells(spark, share=1))}, n_t=9)
    chunks.save_chunked(cube, f"{tmp_path}/s", chunks=(4, 2, 5))
    back = chunks.load_chunked(spark, f"{tmp_path}/s")
    for pick, opened in ((lambda c: c[2:7], 12), (lambda c: c[2:7][:, [4, 0]], 8), (lambda c: c[2:7, 4, -1], 2), (lambda c: c[20:3:-6][1:, :, 8], 9), (lambda c: c[:, "3"], 36), (lambda c: c[[5, 1]], 12)):
        assert key(pick(back).X.cells) == key(pick(cube).X.cells)
        assert pick(back).X.cells.rdd.getNumPartitions() == opened
    both = back[:3].X.cells.union(back[18:].X.cells).union(back.X.cells)
    assert both.count() == (3 + 5 + 23) * 45
    assert key(back[2:7].with_layer("X", back.X.cells, depth=9)[:2].X.cells) == key(cube[:2].X.cells), "cells that are not those of the store"


def test_neighbours_share_a_partition(spark, tmp_path):
    chunks.write_array(cells(spark), f"{tmp_path}/a", SHAPE, chunks=(1, 1, 1))
    assert chunks.read_array(spark, f"{tmp_path}/a").rdd.getNumPartitions() == 1


def test_cubes(spark, tmp_path):
    """Layers with and without time and fill; slices; what a store replaces stays until it is vacuumed."""
    obs = spark.range(23).select(F.col("id").cast("int").alias("obs_idx"), F.col("id").cast("string").alias("obs_name"), (F.col("id") * 2).alias("age"))
    var = spark.range(5).select(F.col("id").cast("int").alias("var_idx"), F.concat(F.lit("v"), "id").alias("var_name"))
    layers = {"X": Layer(cells(spark)), "flat": Layer(cells(spark, seed=2, shape=SHAPE[:2]), 2), "counts": Layer(cells(spark, "int", 3), 3, 7)}
    cube = Cube.build(obs, var, None, layers, n_t=9, uns={"note": "x"})
    store = f"{tmp_path}/s"
    chunks.save_chunked(cube, store, chunks="even")
    back = chunks.load_chunked(spark, store)
    assert back.shape == cube.shape and back.uns == {"note": "x"} and key(back.obs) == key(obs)
    for name in layers:
        assert key(back.dense(name).select("obs_idx", "var_idx", "value")) == key(cube.dense(name).select("obs_idx", "var_idx", "value"))
    assert back.layers["counts"].fill == 7 and back.layers["flat"].ndim == 2
    assert key(back[3:17:2, [4, 1], -2:].X.cells) == key(cube[3:17:2, [4, 1], -2:].X.cells)
    with pytest.raises(FileExistsError):
        chunks.save_chunked(cube, store)
    chunks.save_chunked(cube[:4], store, mode="overwrite")
    assert key(back.X.cells) == key(cube.X.cells), "a reader of what was replaced"
    assert chunks.load_chunked(spark, store).shape == (4, 5, 9)
    assert len(chunks.vacuum_chunked(store)) == 4 and chunks.vacuum_chunked(store) == []
    assert key(chunks.load_chunked(spark, store).X.cells) == key(cube[:4].X.cells)


def test_empty_layers_and_wrong_stores(spark, tmp_path, caplog):
    chunks.write_array(cells(spark, share=0), f"{tmp_path}/none", SHAPE)
    assert chunks.read_array(spark, f"{tmp_path}/none").count() == 0
    chunks.write_array(cells(spark, "double"), f"{tmp_path}/nulls", SHAPE, chunks=(4, 5, 9))
    with pytest.raises(ValueError, match="cannot be stored"):
        chunks.write_array(cells(spark, "string"), f"{tmp_path}/text", SHAPE)
    for bad in ("huge", (1, 2), (0, 1, 1)):
        with pytest.raises(ValueError, match="chunks"):
            chunks.write_array(cells(spark), f"{tmp_path}/bad", SHAPE, chunks=bad)
    with pytest.raises(ValueError, match="no attribute"):
        chunks.load_chunked(spark, f"{tmp_path}/nulls")
    chunks.put_json(f"{tmp_path}/other/.zattrs", {"encoding-type": "else"})
    with pytest.raises(ValueError, match="unknown encoding-type"):
        chunks.load_chunked(spark, f"{tmp_path}/other")


def test_a_failed_write_leaves_no_array(spark, tmp_path):
    """A task that fails, or rows of a chunk that were not together: nothing that a reader could take for an array."""
    outside = cells(spark).unionByName(spark.createDataFrame([(99, 0, 0, 1.0)], "obs_idx int, var_idx int, t_idx int, value double"))
    with pytest.raises(Exception, match="outside the array"):
        chunks.write_array(outside, f"{tmp_path}/a", SHAPE, chunks=(4, 2, 5))
    assert not os.path.exists(tmp_path / "a/.zarray")
    meta = {"zarr_format": 2, "shape": [4, 1, 1], "chunks": [4, 1, 1], "dtype": "<f8", "order": "C", "filters": None, "dimension_separator": ".", "compressor": None, "fill_value": "NaN"}
    rows = spark.createDataFrame([(k, 0, 0, 1.0) for k in range(4)], "obs_idx int, var_idx int, t_idx int, value double").repartition(4, "obs_idx")
    with pytest.raises(Exception, match="not together"):
        rows.write.format("chunks").mode("append").option("path", f"{tmp_path}/b").option("meta", json.dumps(meta)).save()
    assert not os.path.exists(tmp_path / "b")
