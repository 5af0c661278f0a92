"""Tensors for training: written once by Spark, then read by any number of processes without it.

The tensors lie in Parquet files sorted by observation; an index of their row groups gives the position of each, so that a reader
finds an observation with one search and reads one row group.  Readers of an epoch share its row groups: a permutation from seed and
epoch, the same in all of them, is dealt out, and rows are shuffled within groups in the order of the same seed.  Each
observation is so given once in an epoch, whatever the number of readers, and any reader can begin again at any place.
"""

from __future__ import annotations

import sys
import uuid
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from ..sources.chunks import file_system
from ..sources.scratch import shared_dir

# executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a row group, about, and row groups that a reader keeps.
GROUP, KEPT = 8 << 20, 8
INDEX = "_index.parquet"


def _row_groups(path: str):
    """Over file names: of each file its row groups, with their sizes and first observations."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, root = file_system(path)
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                with files.open_input_file(f"{root}/{name}") as f:
                    meta = pq.ParquetFile(f).metadata
                    column = next(k for k in range(meta.num_columns) if meta.schema.column(k).path == "obs_idx")
                    rows += [(name, g, meta.row_group(g).num_rows, meta.row_group(g).column(column).statistics.min) for g in range(meta.num_row_groups)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["file", "row_group", "n", "first"])

    return run


def write_feed(tensors: DataFrame, path: str, *, group_bytes: int = GROUP) -> int:
    """Write tensors (obs_idx, features, label) and the index; returns their number.

    The index has a row for each row group, some 10 MB for each TB of tensors; it is the last file to be written.
    """
    import pyarrow as pa
    import pyarrow.parquet as pq

    spark, path = tensors.sparkSession, path.rstrip("/")
    rows = tensors.select("obs_idx", "features", "label").repartitionByRange("obs_idx").sortWithinPartitions("obs_idx")
    rows.write.option("parquet.block.size", group_bytes).option("parquet.page.size.row.check.min", 10).parquet(path)
    names = spark.read.format("binaryFile").load(path).selectExpr("regexp_extract(path, '[^/]+$', 0) AS file")
    groups = names.mapInArrow(_row_groups(path), "file string, row_group int, n long, first long").toArrow().sort_by("first")
    n = groups.column("n").to_numpy()
    groups = groups.append_column("start", pa.array(np.cumsum(n) - n))
    files, root = file_system(path)
    with files.open_output_stream(f"{root}/{INDEX}") as f:
        pq.write_table(groups, f)
    return int(n.sum())


class TensorFeed:
    """Tensors with labels, by position or one after another; needs no Spark."""

    def __init__(self, path: str):
        import pyarrow.parquet as pq

        self.path = path.rstrip("/")
        files, root = file_system(self.path)
        with files.open_input_file(f"{root}/{INDEX}") as f:
            index = pq.read_table(f)
        self.files, self.groups = index.column("file").to_pylist(), index.column("row_group").to_pylist()
        self.starts, self.sizes = index.column("start").to_pylist(), index.column("n").to_pylist()
        self.kept: OrderedDict[int, tuple] = OrderedDict()

    def __len__(self) -> int:
        return self.starts[-1] + self.sizes[-1] if self.starts else 0

    def _group(self, g: int) -> tuple:
        """obs_idx, features as float32 (rows x variables x time), labels of a row group."""
        if g in self.kept:
            self.kept.move_to_end(g)
            return self.kept[g]
        import pyarrow.parquet as pq

        files, root = file_system(self.path)
        with files.open_input_file(f"{root}/{self.files[g]}") as f:
            rows = pq.ParquetFile(f).read_row_group(self.groups[g]).combine_chunks()
        features = rows.column("features").combine_chunks()
        inner = features.flatten()
        n, variables = len(features), len(inner)
        values = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        shape = (n, variables // n, len(values) // max(variables, 1))
        self.kept[g] = rows.column("obs_idx").to_numpy(), values.reshape(shape), rows.column("label").to_numpy()
        if len(self.kept) > KEPT:
            self.kept.popitem(last=False)
        return self.kept[g]

    def __getitem__(self, k: int) -> tuple:
        """(float32 array, label) at a position; negative ones count from the end."""
        size = len(self)
        if not -size <= k < size:
            raise IndexError(f"observation {k} is outside 0 to {size - 1}")
        g = bisect_right(self.starts, k % size) - 1
        _, features, labels = self._group(g)
        at = k % size - self.starts[g]
        return features[at], labels[at]

    def read(self, shard: int = 0, shards: int = 1, *, seed: int | None = None, epoch: int = 0, skip: int = 0) -> Iterator[tuple]:
        """(obs_idx, float32 array, label) of a shard's part of an epoch, shuffled if there is a seed; skip leaves out its first ones."""
        if not 0 <= shard < shards:
            raise ValueError("shard must be one of 0 to shards - 1")
        order = np.arange(len(self.starts))
        if seed is not None:
            np.random.default_rng([seed, epoch]).shuffle(order)
        for g in order[shard::shards].tolist():
            if skip >= self.sizes[g]:
                skip -= self.sizes[g]
                continue
            obs, features, labels = self._group(g)
            rows = np.arange(len(obs))
            if seed is not None:
                np.random.default_rng([seed, epoch, g]).shuffle(rows)
            for at in rows[skip:].tolist():
                yield int(obs[at]), features[at], labels[at]
            skip = 0


class TensorSet(TensorFeed):
    """Tensors of a frame, written to the shared folder: a length, and any of them by its number."""

    def __init__(self, tensors: DataFrame):
        path = f"{shared_dir(tensors.sparkSession)}/tensors-{uuid.uuid4().hex}"
        write_feed(tensors, path)
        super().__init__(path)
