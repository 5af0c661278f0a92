"""Layers as chunked arrays on disk, by a data source of Spark's own Python interface.

A store is a folder with JSON metadata: an array's folder has .zarray and a file for each chunk, named by the chunk's place
(version 2 of the public Zarr specification, raw or zlib, C order), so that any reader of that format opens it.  A chunk
holds a box of cells as a dense array; chunks without cells have no file.

Reading: a partition holds whole chunks, of PARTITION bytes at most where they are small; a box of positions chooses the
chunks and is applied in them, and slices of a stored cube read anew with their box, so that they open the files that they
touch and no others.  (The interface has pushed filters too, but all scans of one relation share what was pushed last, in
4.1.2: two slices of it in a query lose rows.)  Writing: cells are dealt by chunk, each task writes whole chunks under a new folder, and the driver
writes the metadata when all tasks have ended: an array without metadata does not exist.  The store's
attributes name the arrays' folders and are replaced last, so that a save that fails changes nothing.

Paths are those of pyarrow.fs (local and file:, s3:, gs:, abfs:, hdfs:) and must mean the same to Spark.
"""

from __future__ import annotations

import itertools
import json
import logging
import math
import sys
import uuid
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.cube import Cube, Layer, Stored, default_tem
from ..operators.features import cast_variables_to_float, harmonize_missing_values

log = logging.getLogger(__name__)
# executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INDEXES = ("obs_idx", "var_idx", "t_idx")
#: Types of values: Spark's, numpy's.
TYPES = {"double": "<f8", "float": "<f4", "bigint": "<i8", "int": "<i4", "smallint": "<i2", "tinyint": "|i1", "boolean": "|b1"}
#: Bytes of decoded chunks in a partition, at most (a chunk at least), and cells of a chunk of automatic size.
PARTITION, CELLS = 1 << 24, 1 << 18
ENCODING = "chronolake-cube"


def file_system(path: str):
    """pyarrow's file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if path.split("/")[0].endswith(":") else (fs.LocalFileSystem(), path)


def put(files, at: str, data: bytes) -> None:
    """Replace a file: a reader sees the old one or the new one."""
    new = f"{at}.{uuid.uuid4().hex}"
    with files.open_output_stream(new) as f:
        f.write(data)
    files.move(new, at)


def get_json(path: str) -> dict:
    files, at = file_system(path)
    with files.open_input_stream(at) as f:
        return json.loads(f.read())


def put_json(path: str, value: dict) -> None:
    files, at = file_system(path)
    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
    put(files, at, json.dumps(value, indent=1).encode())


def chunk_shape(shape: Sequence[int], chunks) -> tuple[int, ...]:
    """"auto": about CELLS cells, long in time, then in variables; "even": as long on each axis, 2**(16 / axes) / 2; or given lengths."""
    if chunks == "even":
        return tuple(max(min(int(2 ** (16 / len(shape))) // 2, n), 1) for n in shape)
    if chunks == "auto":
        steps = min(shape[2], 256) if len(shape) == 3 else 1
        variables = min(shape[1], 64)
        rows = max(min(shape[0], CELLS // max(steps * variables, 1)), 1)
        return tuple(max(n, 1) for n in (rows, variables, steps)[: len(shape)])
    if isinstance(chunks, str) or len(chunks) != len(shape) or any(int(c) != c or c < 1 for c in chunks):
        raise ValueError("chunks must be auto, even, or a positive length for each axis")
    return tuple(int(c) for c in chunks)


class Box:
    """Positions of each axis: a first and last one and, of some, a set; within: ranges and lists by index."""

    def __init__(self, shape: Sequence[int], within: dict):
        self.low, self.high = [0] * len(shape), [n - 1 for n in shape]
        self.among: list[set | None] = [None] * len(shape)
        for k, name in enumerate(INDEXES[: len(shape)]):
            if name in within:
                given = within[name]
                first, last = (min(given), max(given)) if len(given) else (1, 0)
                self.low[k], self.high[k] = max(self.low[k], first), min(self.high[k], last)
                self.among[k] = None if isinstance(given, range) and abs(given.step) == 1 else set(given)

    def chunks(self, size: Sequence[int]) -> list[list[int]]:
        """Numbers of the chunks of each axis that hold a position."""
        out = []
        for k, n in enumerate(size):
            if self.low[k] > self.high[k]:
                out.append([])
            elif self.among[k] is None:
                out.append(list(range(self.low[k] // n, self.high[k] // n + 1)))
            else:
                out.append(sorted({v // n for v in self.among[k] if self.low[k] <= v <= self.high[k]}))
        return out

    def inside(self, k: int, positions: np.ndarray) -> np.ndarray:
        ok = (positions >= self.low[k]) & (positions <= self.high[k])
        return ok if self.among[k] is None else ok & np.isin(positions, list(self.among[k]))


@dataclass
class Chunks(InputPartition):
    """Places of a partition's chunks."""

    places: list


@dataclass
class Done(WriterCommitMessage):
    """Numbers of the chunks that a task wrote, as 64-bit integers, and bytes."""

    chunks: bytes


class ChunkReader(DataSourceReader):
    """Cells other than the fill of an array."""

    def __init__(self, path: str, meta: dict, within: dict):
        self.path, self.meta, self.box = path, meta, Box(meta["shape"], within)

    def partitions(self):
        """Chunks lie in the order of their places, and neighbours share a partition."""
        size = self.meta["chunks"]
        many = max(PARTITION // (math.prod(size) * np.dtype(self.meta["dtype"]).itemsize), 1)
        places = itertools.product(*self.box.chunks(size))
        out = []
        while some := list(itertools.islice(places, many)):
            out.append(Chunks(some))
        return out or [Chunks([])]

    def read(self, partition):
        import pyarrow as pa

        files, root = file_system(self.path)
        size, shape, kind = self.meta["chunks"], self.meta["shape"], np.dtype(self.meta["dtype"])
        fill = fill_value(self.meta)
        names = [*INDEXES[: len(size)], "value"]
        for place in partition.places:
            try:
                with files.open_input_stream(f"{root}/{self.meta['dimension_separator'].join(map(str, place))}") as f:
                    data = f.read()
            except FileNotFoundError:
                continue
            data = zlib.decompress(data) if self.meta["compressor"] else data
            cells = np.frombuffer(data, kind).reshape(size)
            at = [np.arange(p * n, min(p * n + n, m)) for p, n, m in zip(place, size, shape, strict=True)]
            keep = [np.flatnonzero(self.box.inside(k, v)) for k, v in enumerate(at)]
            cells = cells[np.ix_(*keep)]
            some = ~np.isnan(cells) if fill is None else cells != fill
            found = np.nonzero(some)
            index = [pa.array(at[k][keep[k]][i], pa.int32()) for k, i in enumerate(found)]
            yield pa.RecordBatch.from_arrays([*index, pa.array(cells[found])], names=names)


class ChunkWriter(DataSourceArrowWriter):
    """Whole chunks from rows that are sorted by chunk."""

    def __init__(self, path: str, meta: dict):
        self.path, self.meta = path, meta

    def write(self, iterator):
        files, root = file_system(self.path)
        size, shape, kind = self.meta["chunks"], self.meta["shape"], np.dtype(self.meta["dtype"])
        grid = [-(-n // c) for n, c in zip(shape, size, strict=True)]
        fill = fill_value(self.meta)
        files.create_dir(root, recursive=True)
        done, number, cells = [], None, None

        def close():
            data = cells.tobytes()
            place = self.meta["dimension_separator"].join(str(int(p)) for p in np.unravel_index(number, grid))
            put(files, f"{root}/{place}", zlib.compress(data, self.meta["compressor"]["level"]) if self.meta["compressor"] else data)
            done.append(number)

        for batch in iterator:
            if not batch.num_rows:
                continue
            at = [np.array(batch.column(c)) for c in INDEXES[: len(size)]]
            value = batch.column("value")
            if any((v < 0).any() or (v >= n).any() for v, n in zip(at, shape, strict=True)):
                raise ValueError("a cell lies outside the array")
            numbers = np.ravel_multi_index([v // n for v, n in zip(at, size, strict=True)], grid)
            inner = np.ravel_multi_index([v % n for v, n in zip(at, size, strict=True)], size)
            values = value.fill_null(math.nan if fill is None else fill).to_numpy(zero_copy_only=False).astype(kind)
            edge = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in itertools.pairwise(edge):
                if numbers[a] != number:
                    if cells is not None:
                        close()
                    number, cells = int(numbers[a]), np.full(math.prod(size), math.nan if fill is None else fill, kind)
                cells[inner[a:b]] = values[a:b]
        if cells is not None:
            close()
        return Done(np.array(done, np.int64).tobytes())

    def commit(self, messages):
        """The metadata make the array exist; a chunk that two tasks wrote would have lost cells."""
        done = np.concatenate([np.frombuffer(m.chunks, np.int64) for m in messages if m] or [np.zeros(0, np.int64)])
        if len(np.unique(done)) < len(done):
            self.abort(messages)
            raise ValueError("the rows of a chunk were not together")
        put_json(f"{self.path}/.zarray", self.meta)

    def abort(self, messages):
        from pyarrow import fs

        files, root = file_system(self.path)
        if files.get_file_info(root).type != fs.FileType.NotFound:
            files.delete_dir(root)


class ChunkSource(DataSource):
    """Format "chunks": option path, an array's folder; within, a box to read; to write, option meta, its metadata."""

    @classmethod
    def name(cls):
        return "chunks"

    def _meta(self) -> dict:
        return get_json(f"{self.options['path']}/.zarray")

    def schema(self):
        meta = self._meta()
        kind = next(k for k, v in TYPES.items() if v == meta["dtype"])
        return ", ".join([*(f"{c} int" for c in INDEXES[: len(meta["shape"])]), f"value {kind}"])

    def reader(self, schema):
        within = {k: range(*v["range"]) if isinstance(v, dict) else v for k, v in json.loads(self.options.get("within", "{}")).items()}
        return ChunkReader(self.options["path"], self._meta(), within)

    def writer(self, schema, overwrite):
        return ChunkWriter(self.options["path"], json.loads(self.options["meta"]))


def fill_value(meta: dict):
    """None where cells are missing, which are NaN in the array."""
    return None if meta["fill_value"] == "NaN" else meta["fill_value"]


def read_array(spark: SparkSession, path: str, within: dict[str, range | list[int]] | None = None) -> DataFrame:
    """Cells of an array: the indexes of its axes, and value; those at the given positions of some indexes only."""
    spark.dataSource.register(ChunkSource)
    box = {k: {"range": [v.start, v.stop, v.step]} if isinstance(v, range) else [int(p) for p in v] for k, v in (within or {}).items()}
    return spark.read.format("chunks").option("path", path).option("within", json.dumps(box)).load()


def write_array(cells: DataFrame, path: str, shape: Sequence[int], *, chunks="auto", fill: float | None = None, level: int | None = 1) -> None:
    """Write cells (indexes, value) as an array; level of zlib, or None for raw chunks.

    Integers and flags whose layer has no fill become doubles, as cells may be missing.
    """
    kind = dict(cells.dtypes)["value"]
    if kind not in TYPES:
        raise ValueError(f"an array of {kind} cannot be stored")
    if fill is None and kind not in ("double", "float"):
        cells, kind = cells.withColumn("value", F.col("value").cast("double")), "double"
    if fill is not None and kind == "boolean":
        fill = bool(fill)
    elif fill is not None and kind not in ("double", "float"):
        fill = int(fill)
    size = chunk_shape(shape, chunks)
    meta = {
        "zarr_format": 2, "shape": list(shape), "chunks": list(size), "dtype": TYPES[kind], "order": "C", "filters": None, "dimension_separator": ".",
        "compressor": None if level is None else {"id": "zlib", "level": level}, "fill_value": "NaN" if fill is None else fill,
    }
    cells.sparkSession.dataSource.register(ChunkSource)
    names = INDEXES[: len(shape)]
    places = [F.call_function("div", F.col(c), F.lit(n)) for c, n in zip(names, size, strict=True)]
    rows = cells.where(F.col("value").isNotNull()).select(*(F.col(c).cast("int").alias(c) for c in names), "value")
    rows.repartition(*places).sortWithinPartitions(*places).write.format("chunks").mode("append").option("path", path).option("meta", json.dumps(meta)).save()


def save_chunked(cube: Cube, path: str, *, chunks="auto", level: int | None = 1, mode: str = "errorifexists") -> None:
    """Store a cube: layers as chunked arrays, frames as Parquet beside them.

    mode is errorifexists or overwrite.  Everything goes to new folders; what the store held before stays on
    disk until vacuum_chunked, so that readers of it end well.
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError("mode must be errorifexists or overwrite")
    store = path.rstrip("/")
    if mode == "errorifexists" and _attributes(store) is not None:
        raise FileExistsError(f"{store} holds a store")
    run = uuid.uuid4().hex
    layers = {}
    for name, layer in cube.layers.items():
        folder = f"{name}-{run}"
        write_array(layer.cells, f"{store}/{folder}", cube.shape[: layer.ndim], chunks=chunks, fill=layer.fill, level=level)
        layers[name] = {"array": folder, "fill": layer.fill}
    frames = {"obs": cube.obs, "var": cube.var, "tem": cube.tem}
    for name, df in frames.items():
        df.write.parquet(f"{store}/frames-{run}/{name}")
    put_json(f"{store}/.zgroup", {"zarr_format": 2})
    plain = {k: v for k, v in cube.uns.items() if not isinstance(v, DataFrame)}
    put_json(f"{store}/.zattrs", {"encoding-type": ENCODING, "encoding-version": "1", "frames": f"frames-{run}", "tables": sorted(frames), "shape": list(cube.shape), "layers": layers, "uns": plain})


def _attributes(store: str) -> dict | None:
    try:
        return get_json(f"{store}/.zattrs")
    except FileNotFoundError:
        return None


def load_chunked(spark: SparkSession, path: str, *, harmonize_missing_values_: bool = True, cast_variables_to_float_: bool = True) -> Cube:
    """A stored cube; slices of it open the chunks that they touch. Without a table of time steps there is a default one."""
    store = path.rstrip("/")
    meta = _attributes(store)
    if meta is None or "encoding-type" not in meta:
        raise ValueError("the store has no attribute encoding-type")
    if meta["encoding-type"] != ENCODING:
        raise ValueError(f"unknown encoding-type {meta['encoding-type']!r}")
    frames = {name: spark.read.parquet(f"{store}/{meta['frames']}/{name}") for name in meta["tables"]}
    n_obs, n_vars, n_t = meta["shape"]
    if "tem" not in frames:
        log.warning("The store has no table tem.")
        frames["tem"] = default_tem(spark, n_t)
    layers = {}
    for name, v in meta["layers"].items():
        read = partial(read_array, spark, f"{store}/{v['array']}")
        cells = read()
        layers[name] = Layer(cells, len(cells.columns) - 1, v["fill"], Stored(read, cells))
    cube = Cube(frames["obs"], frames["var"], frames["tem"], layers, n_obs, n_vars, n_t, meta["uns"])
    if harmonize_missing_values_:
        cube = harmonize_missing_values(cube)
    if cast_variables_to_float_:
        for name in layers:
            cube = cast_variables_to_float(cube, name)
    return cube


def vacuum_chunked(path: str) -> list[str]:
    """Delete the folders of a store that its attributes do not name; returns their names. No save may be under way."""
    from pyarrow import fs

    store = path.rstrip("/")
    meta = _attributes(store)
    if meta is None:
        raise ValueError("there is no store")
    files, root = file_system(store)
    named = {meta["frames"], *(v["array"] for v in meta["layers"].values())}
    old = [f for f in files.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and f.base_name not in named]
    for f in old:
        files.delete_dir(f.path)
    return sorted(f.base_name for f in old)
