"""Executors that have no copy of the package on their path run every operator."""

import os
import subprocess
import sys

from chronolake.llm import catalogue

from ..conftest import ROOT

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", sys.argv[2]).config("spark.driver.memory", "3g").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
seen = spark.sparkContext.parallelize([0], 1).map(lambda _: __import__("importlib.util").util.find_spec("chronolake") is not None).collect()
assert seen == [False], "the executors see the package"
from chronolake.llm import catalogue
for name, query in catalogue.queries().items():
    if name != "pipeline":
        print(name, query(spark, sys.argv[3]).count())
"""


def test_executors_without_the_package(odd, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "elsewhere").mkdir()
    run = subprocess.run([sys.executable, "-c", CODE, ROOT, str(tmp_path / "shared"), odd], env=env, cwd=tmp_path / "elsewhere", capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-3000:]
    assert len(run.stdout.split("\n")) == 1 + len(catalogue.queries())
