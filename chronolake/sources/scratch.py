"""The folder for tables between steps, which the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder in the warehouse, or a temporary one in local mode."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/chronolake-steps"
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="chronolake-"))
    return _local[0]
