"""The cube: observations x variables x time as lazy DataFrames.

A layer is a long DataFrame (obs_idx, var_idx, t_idx, value); a cell that has no row is missing, or
holds the layer's fill.  Axis frames hold dense ordinals from 0.  Nothing is copied: each operation
returns a new cube.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir

AXES = ("obs", "var", "tem")
INDEX = {"obs": "obs_idx", "var": "var_idx", "tem": "t_idx"}
NAME = {"obs": "obs_name", "var": "var_name", "tem": "tem_name"}
#: Numbers that an expression may hold as one literal array.
LITERALS = 1000
#: Variables and time steps, at most, whose cells of one observation are laid out as arrays.
ARRAYS = 1000


@dataclass(frozen=True)
class Stored:
    """A layer's way back to its store: read(box) gives the cells of a box, positions by index, and few others.

    Slices read anew what they take, so that files outside are not opened, and repeat the moves made since.
    """

    read: Callable[[dict[str, range | list[int]]], DataFrame]
    cells: DataFrame
    box: dict[str, range | list[int]] = field(default_factory=dict)
    moves: tuple[Callable[[DataFrame], DataFrame], ...] = ()

    def picked(self, index: str, chosen: range | list[int], move: Callable[[DataFrame], DataFrame]) -> Stored:
        # positions of an axis that was sliced before are no longer the store's
        box, moves = self.box if index in self.box else self.box | {index: chosen}, (*self.moves, move)
        cells = self.read(box)
        for m in moves:
            cells = m(cells)
        return Stored(self.read, cells, box, moves)


@dataclass(frozen=True)
class Layer:
    """Cells of a layer; ndim is 2 where they have no t_idx. stored counts only while its cells are the layer's."""

    cells: DataFrame
    ndim: int = 3
    fill: float | None = None
    stored: Stored | None = None

    def picked(self, index: str, chosen: range | list[int] | None, move: Callable[[DataFrame], DataFrame]) -> Layer:
        """The layer after a choice of positions on an axis, which move makes."""
        if chosen is None or self.stored is None or self.stored.cells is not self.cells:
            return replace(self, cells=move(self.cells), stored=None)
        stored = self.stored.picked(index, chosen, move)
        return replace(self, cells=stored.cells, stored=stored)


def with_ordinals(df: DataFrame, index: str, order: Sequence[Column] | None = None) -> DataFrame:
    """Add dense ordinals from 0 in the given order; see counted_ordinals."""
    return counted_ordinals(df, index, order)[0]


def counted_ordinals(df: DataFrame, index: str, order: Sequence[Column] | None = None) -> tuple[DataFrame, int]:
    """Dense ordinals from 0 in the given order, without one task that sees all rows, and the number of rows.

    Rows are sorted into ranges; each partition counts its rows, and the few partition sizes give
    the offsets.  The ranges are pinned, as another run could sample other bounds.
    """
    spark = df.sparkSession
    ranged = (df.orderBy(*order) if order else df).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ranged = pinned(ranged)
    sizes = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}  # a row per partition
    offsets, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        offsets.append(total - (part << 33))
        total += sizes.get(part, 0)
    if not offsets:
        return ranged.withColumn(index, F.lit(0)).drop("_part", "_at"), 0
    if len(offsets) <= LITERALS:
        return ranged.withColumn(index, (F.col("_at") + F.get(F.lit(offsets), F.col("_part"))).cast("int")).drop("_part", "_at"), total
    shift = spark.createDataFrame(list(enumerate(offsets)), "_part int, _shift long")
    return ranged.join(F.broadcast(shift), "_part").withColumn(index, (F.col("_at") + F.col("_shift")).cast("int")).drop("_part", "_at", "_shift"), total


def pinned(df: DataFrame) -> DataFrame:
    """df with its row order fixed by a checkpoint in the shared folder, which survives lost executors.

    A frame that comes out of a shuffle may be computed in another order the next time.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def ranked(df: DataFrame, index: str) -> DataFrame:
    """Close the gaps of an axis frame's ordinals after a filter; the old ones stay as _old."""
    renamed = df.withColumnRenamed(index, "_old")
    return with_ordinals(renamed, index, [F.col("_old")])


@dataclass(frozen=True)
class Cube:
    """Axis frames, layers and the three sizes; ``X`` is the layer of that name."""

    obs: DataFrame
    var: DataFrame
    tem: DataFrame
    layers: dict[str, Layer] = field(default_factory=dict)
    n_obs: int = 0
    n_vars: int = 0
    n_t: int = 1
    uns: dict[str, Any] = field(default_factory=dict)
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    varm: dict[str, DataFrame] = field(default_factory=dict)
    obsp: dict[str, DataFrame] = field(default_factory=dict)
    varp: dict[str, DataFrame] = field(default_factory=dict)
    is_view: bool = False

    @classmethod
    def build(cls, obs: DataFrame, var: DataFrame, tem: DataFrame | None = None, layers: dict[str, Layer] | None = None, *, n_t: int | None = None, **more) -> Cube:
        """A cube from axis frames; sizes are counted once, a default time axis has names "0", "1", ..."""
        layers = layers or {}
        depth = {layer.ndim for layer in layers.values()}
        if tem is None:
            if n_t is None:
                n_t = max((_depth(layer) for layer in layers.values() if layer.ndim == 3), default=1) if 3 in depth else 1
            tem = default_tem(obs.sparkSession, n_t)
        n_t = n_t if n_t is not None else tem.count()
        return cls(obs, var, tem, layers, obs.count(), var.count(), n_t, **more)

    from_tables = build

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.n_obs, self.n_vars, self.n_t

    @property
    def X(self) -> Layer | None:
        return self.layers.get("X")

    def copy(self) -> Cube:
        return replace(self, is_view=False)

    def with_layer(self, name: str, cells: DataFrame, ndim: int = 3, depth: int | None = None, fill: float | None = None) -> Cube:
        """Add or replace a layer; the first deep layer of a flat cube sets the time axis."""
        layer = Layer(cells, ndim, fill)
        tem, n_t = self.tem, self.n_t
        if ndim == 3:
            depth = depth if depth is not None else _depth(layer)
            if depth not in (n_t, 1):
                if n_t != 1:
                    raise ValueError(f"the layer has {depth} time steps, the cube {n_t}")
                tem, n_t = default_tem(cells.sparkSession, depth), depth
        return replace(self, layers=self.layers | {name: layer}, tem=tem, n_t=n_t)

    def with_tem(self, tem: DataFrame) -> Cube:
        if not isinstance(tem, DataFrame):
            raise ValueError("tem must be a DataFrame")
        n = tem.count()
        if self.n_t not in (1, n):
            raise ValueError(f"tem has {n} rows, the cube {self.n_t} time steps")
        return replace(self, tem=tem, n_t=n)

    def sel(self, obs: Any = None, var: Any = None, tem: Any = None) -> Cube:
        """Pick along the axes: slices, positions, labels, lists, masks or conditions; lists give the outer product."""
        out = self
        for axis, key in zip(AXES, (obs, var, tem), strict=True):
            if key is not None and not (isinstance(key, slice) and key == slice(None)):
                out = out._pick(axis, key)
        return replace(out, is_view=True)

    def __getitem__(self, key: Any) -> Cube:
        key = key if isinstance(key, tuple) else (key,)
        if len(key) > 3:
            raise IndexError("a cube has three axes")
        return self.sel(*key, *[None] * (3 - len(key)))

    def _pick(self, axis: str, key: Any) -> Cube:
        frame, index, size = getattr(self, axis), INDEX[axis], {"obs": self.n_obs, "var": self.n_vars, "tem": self.n_t}[axis]
        chosen = positions(key, frame, index, NAME[axis], size)
        if chosen is None:
            kept = ranked(frame.where(key if isinstance(key, Column) else F.col(NAME[axis]) == key), index)
            moved = kept.select(F.col("_old").alias(index), F.col(index).alias("_new"))
            kept, n = kept.drop("_old"), kept.count()
            move = lambda df, column=index: _moved(df, moved, index, column)
        else:
            n = len(chosen)
            move = lambda df, column=index: _renumbered(df, column, chosen, size)
            kept = move(frame)
        layers = {k: v.picked(index, chosen, move) if axis != "tem" or v.ndim == 3 else v for k, v in self.layers.items()}
        sizes = {"obs": {"n_obs": n}, "var": {"n_vars": n}, "tem": {"n_t": n}}[axis]
        more = {}
        if axis in ("obs", "var"):
            more[f"{axis}m"] = {k: move(v) for k, v in getattr(self, f"{axis}m").items()}
            more[f"{axis}p"] = {k: move(move(v, "i"), "j") for k, v in getattr(self, f"{axis}p").items()}
        return replace(self, **{axis: kept}, layers=layers, **sizes, **more)

    def reduce_time(self, name: str, how: str = "max", skipna: bool = True, to: str | None = None) -> Cube:
        """A flat layer of a deep one, by max, min, mean or sum over time.

        Without skipna a cell counts only where all its time steps have values.
        """
        value = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum}[how]("value")
        cells = self.layers[name].cells.groupBy("obs_idx", "var_idx").agg(value.alias("value"), F.count("value").alias("_n"))
        cells = (cells if skipna else cells.where(F.col("_n") == self.n_t)).drop("_n")
        return self.with_layer(to or f"{name}_{how}", cells, ndim=2)

    def rows(self, name: str) -> DataFrame:
        """obs_idx and rows of every observation: an array over variables, of arrays over time in a deep layer.

        Cells are gathered by observation in one shuffle and laid out row by row; missing ones are null.
        """
        layer = self.layers[name]
        kind = dict(layer.cells.dtypes)["value"]
        lay = lambda entries, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.try_element_at(F.map_from_entries(entries), k))
        cells, value = layer.cells.repartition("obs_idx"), "value"
        if layer.ndim == 3:
            cells = cells.groupBy("obs_idx", "var_idx").agg(lay(F.collect_list(F.struct("t_idx", "value")), self.n_t).alias("value"))
            kind = f"array<{kind}>"
        cells = cells.groupBy("obs_idx").agg(lay(F.collect_list(F.struct("var_idx", value)), self.n_vars).alias("rows"))
        none = F.lit(None) if layer.ndim == 2 else F.array_repeat(F.lit(None).cast(kind[6:-1]), self.n_t)
        rows = F.coalesce("rows", F.array_repeat(F.lit(None).cast(kind), self.n_vars))
        return self.obs.select("obs_idx").join(cells, "obs_idx", "left").select("obs_idx", F.transform(rows, lambda v: F.coalesce(v, none.cast(kind))).alias("rows"))

    def dense(self, name: str) -> DataFrame:
        """All cells of a layer, missing ones included."""
        layer = self.layers[name]
        if 0 < self.n_vars <= ARRAYS and self.n_t <= ARRAYS:
            out = self.rows(name).select("obs_idx", F.posexplode("rows").alias("var_idx", "value"))
            if layer.ndim == 3:
                out = out.select("obs_idx", "var_idx", F.posexplode("value").alias("t_idx", "value"))
        else:
            cells = self.obs.select("obs_idx").crossJoin(self.var.select("var_idx"))
            if layer.ndim == 3:
                cells = cells.withColumn("t_idx", F.explode(F.sequence(F.lit(0), F.lit(self.n_t - 1))))
            out = cells.join(layer.cells, cells.columns, "left")
        return out if layer.fill is None else out.withColumn("value", F.coalesce("value", F.lit(layer.fill)))

    def __repr__(self) -> str:
        lines = [f"{'View of ' if self.is_view else ''}Cube object with n_obs × n_vars × n_t = {self.n_obs} × {self.n_vars} × {self.n_t}"]
        for axis in ("obs", "var"):
            if names := [c for c in getattr(self, axis).columns if c not in (INDEX[axis], NAME[axis])]:
                lines.append(f"    {axis}: " + ", ".join(f"'{c}'" for c in names))
        lines.append("    tem: " + ", ".join(f"'{r[0]}'" for r in self.tem.orderBy("t_idx").select("tem_name").limit(50).collect()))
        for part in ("uns", "obsm", "varm", "obsp", "varp", "layers"):
            if names := [k for k in getattr(self, part) if part != "layers" or k != "X"]:
                lines.append(f"    {part}: " + ", ".join(f"'{k}'" for k in names))
        for k, v in sorted(self.layers.items(), key=lambda x: x[0] != "X"):
            lines.append(f"    shape of .{k}: " + str(self.shape if v.ndim == 3 else self.shape[:2]))
        return "\n".join(lines)


def default_tem(spark, n_t: int) -> DataFrame:
    return spark.range(n_t).select(F.col("id").cast("int").alias("t_idx"), F.col("id").cast("string").alias("tem_name"))


def _depth(layer: Layer) -> int:
    return (layer.cells.agg(F.max("t_idx")).first()[0] or 0) + 1


def _moved(cells: DataFrame, moved: DataFrame, index: str, column: str | None = None) -> DataFrame:
    column = column or index
    new = moved.select(F.col(index).alias(column), "_new")
    return cells.join(new, column).drop(column).withColumnRenamed("_new", column).select(*cells.columns)


def _renumbered(df: DataFrame, column: str, chosen: range | list[int], size: int) -> DataFrame:
    """Rows at the chosen positions, with their places among them; a position may be chosen again.

    A range is arithmetic on the position, and a choice on a short axis one literal array; only
    a list on a long axis is joined, and that is as long as what the caller holds.
    """
    at, columns = F.col(column), df.columns
    if isinstance(chosen, range):
        step, inside = chosen.step, sorted((chosen.start, chosen[-1])) if len(chosen) else (1, 0)
        kept = df.where(at.between(*inside) & ((at - chosen.start) % step == 0))
        return kept.withColumn(column, F.call_function("div", at - chosen.start, F.lit(step)).cast("int"))
    if size > LITERALS or not size:
        moved = df.sparkSession.createDataFrame([(old, new) for new, old in enumerate(chosen)], "_at int, _new int")
        return df.join(F.broadcast(moved) if len(chosen) <= 1_000_000 else moved, at == F.col("_at")).drop(column, "_at").withColumnRenamed("_new", column).select(*columns)
    places: list[list[int]] = [[] for _ in range(size)]
    for new, old in enumerate(chosen):
        places[old].append(new)
    if max(map(len, places)) <= 1:
        new = F.get(F.lit([v[0] if v else None for v in places]).cast("array<int>"), at) if any(places) else F.lit(None).cast("int")
        return df.withColumn(column, new).where(at.isNotNull())
    every = F.get(F.array(*[F.lit(v).cast("array<int>") if v else F.array().cast("array<int>") for v in places]), at)
    return df.withColumn("_new", F.explode(every)).drop(column).withColumnRenamed("_new", column).select(*columns)


def positions(key: Any, frame: DataFrame, index: str, name: str, size: int) -> range | list[int] | None:
    """The positions that a key names, in its order; None for conditions and single labels.

    Integers keep their axis.  Slices of labels include both ends.  Arrays and series of numpy and
    pandas are taken like lists: of flags, one for each row, of labels, or of positions.
    """
    if isinstance(key, Column | str):
        return None
    key = key.tolist() if hasattr(key, "tolist") else key
    if isinstance(key, bool):
        raise IndexError("a mask must have an entry per row")
    if isinstance(key, slice):
        ends = [k.item() if hasattr(k, "item") else k for k in (key.start, key.stop)]
        labels = [k for k in ends if isinstance(k, str)]
        place = _places(frame, index, name, labels) if labels else {}
        first, last = ends
        first = place[first] if isinstance(first, str) else first
        last = place[last] + 1 if isinstance(last, str) else last
        return range(*slice(first, last, key.step).indices(size))
    if isinstance(key, int):
        if not -size <= key < size:
            raise IndexError(f"position {key} is outside an axis of {size}")
        return range(key % size, key % size + 1)
    key = [k.item() if hasattr(k, "item") else k for k in key]
    if key and all(isinstance(k, bool) for k in key):
        if len(key) != size:
            raise IndexError("a mask must have an entry per row")
        return [k for k, yes in enumerate(key) if yes]
    if key and all(isinstance(k, str) for k in key):
        place = _places(frame, index, name, key)
        return [place[k] for k in key]
    if any(isinstance(k, bool | str) or int(k) != k for k in key):
        raise IndexError("a list must hold flags, labels or positions")
    if any(not -size <= k < size for k in key):
        raise IndexError(f"a position is outside an axis of {size}")
    return [int(k) % size for k in key]


def _places(frame: DataFrame, index: str, name: str, labels: list[str]) -> dict[str, int]:
    place = {r[1]: r[0] for r in frame.where(F.col(name).isin(labels)).select(index, name).collect()}
    if missing := [k for k in labels if k not in place]:
        raise KeyError(missing[0])
    return place
