"""Folders of medical-record files as a catalog of lazy tables."""

from __future__ import annotations

import logging
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spec import TABLES
from .sniff import read_sniffed

log = logging.getLogger(__name__)
#: Columns that stay text whatever their values look like.
TEXT_COLUMNS = {"measurement": ("measurement_source_value",)}
TAG = "download_verification_tag"


def table_name(file: str, prefix: str = "") -> str:
    """Table of a file: what stands before the first dot, in lower case, without the prefix."""
    stem = file.split(".")[0].lower()
    return stem.replace(prefix.lower(), "") if prefix else stem


def typed(df: DataFrame) -> DataFrame:
    """Lower-case column names; *_date and *_datetime columns become dates and timestamps without zone."""
    df = df.toDF(*[c.lower() for c in df.columns])
    kinds = {"_datetime": "timestamp_ntz", "_date": "date"}
    return df.withColumns({c: F.col(c).try_cast(kind) for c in df.columns for end, kind in kinds.items() if c.endswith(end)})


class Catalog:
    """Tables by name. Registering a name again replaces it."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        for name, df in (tables or {}).items():
            self.register(name, df)

    def register(self, name: str, df: DataFrame) -> None:
        self.tables[name] = typed(df)
        self.tables[name].createOrReplaceTempView(name)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"table {name} is not in the catalog")
        return self.tables[name]

    def __contains__(self, name: object) -> bool:
        return name in self.tables

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    @classmethod
    def from_dir(cls, spark: SparkSession, path: str, prefix: str = "") -> Catalog:
        """Register every CSV and Parquet file of a folder that is named after a known table.

        The folder may be in any file system that Spark reads.
        """
        out, unused = cls(spark), []
        for name, file in sorted(_files(spark, path)):
            table = table_name(name, prefix)
            if table not in TABLES:
                unused += [name] if name.split(".")[0] != TAG else []
                continue
            kind = name.lower().rsplit(".", 1)[-1]
            if kind == "parquet":
                out.register(table, spark.read.parquet(file))
            elif kind == "csv":
                out.register(table, read_table_csv(spark, file, TEXT_COLUMNS.get(table, ())))
            else:
                log.warning("Files with extension %s are not supported: %s", kind, name)
        missing = sorted(TABLES - set(out.tables))
        log.info("missing tables: %s; unused files: %s", missing, unused)
        return out


def read_table_csv(spark: SparkSession, file: str, text_columns: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file in its own dialect; the named columns are read as text, the types of the others follow from their values."""
    return read_sniffed(spark, file, text_columns=text_columns)


def _files(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return [(s.getPath().getName(), s.getPath().toString()) for s in listed]


def setup_connection(spark: SparkSession, path: str, prefix: str = "") -> Catalog:
    return Catalog.from_dir(spark, path, prefix)
