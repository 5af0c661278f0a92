"""What the operators share: table access, tables written between steps, text buffers."""

from __future__ import annotations

import pickle
import sys
import types
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir

#: ASCII white space separates words; bytes.split() without argument splits at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that Python handles at once; the arrays made of them take some fifty bytes for each.
PIECE = 1 << 19
#: Bytes of an Arrow batch between Spark and Python.
BATCH = 1 << 22
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session to BATCH bytes, unless its own configuration says otherwise.

    Spark's default is 10,000 rows, which of long texts fill much memory on both sides.
    """
    if not spark.sparkContext.getConf().contains(_BATCH_BYTES):
        spark.conf.set(_BATCH_BYTES, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for p in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(p)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def shared_value(spark: SparkSession, value):
    """A broadcast of value, pickled with its class, so that executors need no copy of the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def loaded(shared):
    """The value of shared_value(), in a task."""
    return pickle.loads(shared.value)


def kept_by_worker(key, make):
    """make(), kept for all tasks of the same Python worker.

    Functions are pickled by value, so that their own modules are new in each task; the values stay
    in a module of the process.
    """
    held = sys.modules.setdefault("chronolake_kept_by_worker", types.ModuleType("chronolake_kept_by_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def bucket_of(col: str, n: int):
    """crc32 of a column's text form, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the row offsets into them; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return body, off - off[0]


def pieces(batch, text: str, limit: int = PIECE):
    """Slices of a record batch of at most about ``limit`` bytes of text, one row at least."""
    _, off = text_buffers(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(off, off[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
