"""A cube as a folder of Parquet tables with a log of manifests; the folder may be in any file system Spark writes.

Each save writes its tables to a new folder and then a manifest of the next version, which names that folder.  Readers hold
the version that they began with, however often it is replaced; vacuum deletes what the last versions do not name.
Of two saves that began at one version the first to end wins, and the other is refused.

Cells lie in tiles: they are sorted along a space-filling curve through the three axes, so that a file covers a
compact box of positions, whose bounds are kept in a table.  Slices of a loaded cube open the files alone whose boxes they touch.
"""

from __future__ import annotations

import json
import uuid
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cube import Cube, Layer, Stored
from ..operators.features import cast_variables_to_float, harmonize_missing_values

#: Version 3 has a log of manifests and tiles; 2 one manifest and a folder that it names; 1 the tables beside the manifest.
FORMAT_VERSION = 3
VALUE_TYPES = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean", "string")
LOG = "_versions"
#: Files that a slice names to Spark one by one, at most; beyond that it reads all, and Parquet's own bounds prune.
NAMED = 10_000


class Conflict(RuntimeError):
    """Another save has made the version that this one wanted to make."""


def _folder(spark: SparkSession, path: str):
    """A path and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, files = _folder(spark, path)
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions of a store, in order."""
    return sorted(int(n.split(".")[0]) for n in _names(spark, f"{path.rstrip('/')}/{LOG}") if n.endswith(".json"))


def _next(spark: SparkSession, store: str) -> int:
    """The version that a save which begins now is to make; claimed ones count though they may not be there yet."""
    return max((int(n.split(".")[0]) for n in _names(spark, f"{store}/{LOG}") if n[0].isdigit()), default=0) + 1


def _commit(spark: SparkSession, store: str, version: int, manifest: dict) -> None:
    """Make a version: its claim can be created once only, and its manifest appears whole."""
    log = f"{store}/{LOG}"
    claim, files = _folder(spark, f"{log}/{version:010d}.claim")
    try:
        files.create(claim, False).close()
    except Exception as e:
        if files.exists(claim):
            raise Conflict(f"version {version} of {store} was made by another save") from e
        raise
    new, _ = _folder(spark, f"{log}/_{uuid.uuid4().hex}")
    out = files.create(new, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    files.rename(new, _folder(spark, f"{log}/{version:010d}.json")[0])


def curve(columns: list[Column]) -> Column:
    """The place of a cell on a space-filling curve: the bits of its positions in turn, the lowest 63 in all."""
    bits = 63 // len(columns)
    out = F.lit(0).cast("bigint")
    for b in range(bits):
        for k, c in enumerate(columns):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("bigint"), b).bitwiseAND(1), b * len(columns) + k))
    return out


def _bounds(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """file, n, and the first and last position on each axis of the files of a table, from their index columns."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), *keys)
    return rows.groupBy("file").agg(F.count("*").alias("n"), *(f(k).alias(f"{n}_{k}") for k in keys for n, f in (("low", F.min), ("high", F.max))))


def save(cube: Cube, path: str, *, cells_per_file: int = 20_000_000, mode: str = "errorifexists") -> int:
    """Write all parts as the next version of a store, whose number is returned; layers lie in tiles of some cells_per_file.

    mode is errorifexists or overwrite.  A save that fails, or that another one has overtaken (Conflict), changes nothing.
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError("mode must be errorifexists or overwrite")
    spark, store = cube.obs.sparkSession, path.rstrip("/")
    if mode == "errorifexists" and _names(spark, store):
        raise FileExistsError(f"{store} is not empty")
    version = _next(spark, store)
    data = f"data-{uuid.uuid4().hex}"
    path, layers = f"{store}/{data}", {}
    for name, layer in cube.layers.items():
        kind = dict(layer.cells.dtypes)["value"]
        if kind not in VALUE_TYPES:
            raise ValueError(f"layer {name} holds {kind}, which cannot be stored")
    for name, layer in cube.layers.items():
        keys = ["obs_idx", "var_idx", *["t_idx"] * (layer.ndim == 3)]
        cells = layer.cells.withColumn("_place", curve([F.col(k) for k in keys]))
        cells = cells.repartitionByRange("_place").sortWithinPartitions("_place").drop("_place")
        cells.write.option("maxRecordsPerFile", cells_per_file).parquet(f"{path}/layers/{name}")
        _bounds(spark, f"{path}/layers/{name}", keys).write.parquet(f"{path}/tiles/{name}")
        layers[name] = {"ndim": layer.ndim, "fill": layer.fill}
    frames = {"obs": cube.obs, "var": cube.var, "tem": cube.tem}
    frames |= {f"{part}/{k}": v for part in ("obsm", "varm", "obsp", "varp") for k, v in getattr(cube, part).items()}
    frames |= {f"uns/{k}": v for k, v in cube.uns.items() if isinstance(v, DataFrame)}
    for name, df in frames.items():
        df.write.parquet(f"{path}/{name}")
    plain = {k: v for k, v in cube.uns.items() if not isinstance(v, DataFrame)}
    manifest = {"format_version": FORMAT_VERSION, "data": data, "shape": cube.shape, "layers": layers, "frames": sorted(frames), "uns": plain}
    _commit(spark, store, version, manifest)
    return version


def _between(low: Column, high: Column):
    return lambda p: (p >= low) & (p <= high)


def _read_tiles(cells: DataFrame, path: str, tiles: DataFrame, box: dict) -> DataFrame:
    """The files whose boxes hold a position of the given box."""
    for k, given in box.items():
        if k not in cells.columns:
            continue
        low, high = F.col(f"low_{k}"), F.col(f"high_{k}")
        if not len(given):
            return cells.limit(0)
        tiles = tiles.where((low <= max(given)) & (high >= min(given)))
        if not isinstance(given, range) and len(given) <= 1000:
            tiles = tiles.where(F.exists(F.array(*map(F.lit, sorted(set(given)))), _between(low, high)))
    names = [r["file"] for r in tiles.select("file").limit(NAMED + 1).collect()]
    if len(names) > NAMED:
        return cells
    if not names:
        return cells.limit(0)
    return cells.sparkSession.read.schema(cells.schema).parquet(*(f"{path}/{n}" for n in sorted(names)))


def _manifest(spark: SparkSession, store: str, version: int | None) -> dict:
    """The manifest of a version, or the last one; that of a store without a log."""
    known = versions(spark, store)
    if not known and version is None:
        return json.loads("".join(r[0] for r in spark.read.text(f"{store}/manifest").collect()))
    if version is not None and version not in known:
        raise ValueError(f"{store} has no version {version}")
    return json.loads("".join(r[0] for r in spark.read.text(f"{store}/{LOG}/{version or known[-1]:010d}.json").collect()))


def load(spark: SparkSession, path: str, *, version: int | None = None, harmonize_missing_values_: bool = True, cast_variables_to_float_: bool = True) -> Cube:
    """Read a stored cube, its last version by default; text layers get missing values and numbers recognised unless told otherwise."""
    store = path.rstrip("/")
    manifest = _manifest(spark, store, version)
    written_by = manifest.get("format_version", 1)
    if written_by > FORMAT_VERSION:
        raise ValueError(f"format version {written_by} is newer than this library's")
    path = f"{store}/{manifest['data']}" if "data" in manifest else store
    read = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["frames"]}
    parts = {part: {k.split("/", 1)[1]: v for k, v in read.items() if k.startswith(f"{part}/")} for part in ("obsm", "varm", "obsp", "varp", "uns")}
    layers = {}
    for k, v in manifest["layers"].items():
        cells = spark.read.parquet(f"{path}/layers/{k}")
        stored = None if written_by < 3 else Stored(partial(_read_tiles, cells, f"{path}/layers/{k}", spark.read.parquet(f"{path}/tiles/{k}")), cells)
        layers[k] = Layer(cells, v["ndim"], v["fill"], stored)
    n_obs, n_vars, n_t = manifest["shape"]
    cube = Cube(read["obs"], read["var"], read["tem"], layers, n_obs, n_vars, n_t, manifest["uns"] | parts["uns"], parts["obsm"], parts["varm"], parts["obsp"], parts["varp"])
    if harmonize_missing_values_:
        cube = harmonize_missing_values(cube)
    if cast_variables_to_float_:
        for name in layers:
            cube = cast_variables_to_float(cube, name)
    return cube


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete the data of all but the last versions, and of saves that failed; returns the folders' names. No save may be under way."""
    store = path.rstrip("/")
    known = versions(spark, store)
    if keep < 1 or not known:
        raise ValueError("keep must be 1 at least, of a store with versions")
    named = {_manifest(spark, store, v)["data"] for v in known[-keep:]}
    old = [n for n in _names(spark, store) if n not in named and n != LOG]
    for name in old:
        folder, files = _folder(spark, f"{store}/{name}")
        files.delete(folder, True)
    for v in known[:-keep]:
        folder, files = _folder(spark, f"{store}/{LOG}/{v:010d}.json")
        files.delete(folder, False)
    return sorted(old)


def sparse(cells: DataFrame, fill: float) -> DataFrame:
    """Cells other than the fill; what is dropped comes back with the layer's fill."""
    return cells.where(~F.col("value").eqNullSafe(F.lit(fill)))
