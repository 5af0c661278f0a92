"""The tensor feed: positions, shards, shuffles, and processes that have no Spark."""

import json
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.operators.feed import TensorFeed, TensorSet, write_feed

from .conftest import ROOT

N = 700
CODE = """
import sys, json, types
sys.path.insert(0, sys.argv[1])
from chronolake.operators.feed import TensorFeed
feed = TensorFeed(sys.argv[2])
rows = [(o, float(x[1, 2]), int(label)) for o, x, label in feed.read(int(sys.argv[3]), 3, seed=5, epoch=int(sys.argv[4]))]
assert "pyspark.java_gateway" not in sys.modules or not __import__("pyspark").SparkContext._gateway
print(json.dumps([len(feed), rows]))
"""


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    value = lambda v, t: (F.col("id") * 100 + v * 10 + t).cast("double")
    features = F.array(*(F.array(*(F.when((F.col("id") % 5 == 0) & F.lit(v == 0), float("nan")).otherwise(value(v, t)) for t in range(4))) for v in range(3)))
    tensors = spark.range(N).select(F.col("id").cast("int").alias("obs_idx"), features.alias("features"), (F.col("id") % 2).cast("int").alias("label")).repartition(7)
    out = str(tmp_path_factory.mktemp("feed") / "f")
    assert write_feed(tensors, out, group_bytes=4096) == N
    return out


def test_positions(path):
    feed = TensorFeed(path)
    assert len(feed) == N and len(feed.starts) > 5
    for k in (0, 1, 99, 350, N - 1):
        x, label = feed[k]
        assert x.shape == (3, 4) and x.dtype == np.float32 and x[1, 2] == k * 100 + 12 and label == k % 2 and np.isnan(x[0, 0]) == (k % 5 == 0)
    assert feed[-1][0][1, 2] == (N - 1) * 100 + 12
    for bad in (N, -N - 1):
        with pytest.raises(IndexError):
            feed[bad]
    assert [o for o, _, _ in feed.read()] == list(range(N)), "in order without a seed"


def test_two_processes_share_an_epoch(path):
    """Readers in processes of their own, without Spark: each observation once, in an order that the seed and epoch fix."""
    run = lambda shard, epoch: json.loads(subprocess.run([sys.executable, "-c", CODE, ROOT, path, str(shard), str(epoch)], capture_output=True, text=True, check=True, timeout=120).stdout)
    first = [run(k, 0) for k in range(3)]
    assert all(n == N for n, _ in first)
    rows = [tuple(r) for _, part in first for r in part]
    assert sorted(r[0] for r in rows) == list(range(N)) and all(r[1] == r[0] * 100 + 12 and r[2] == r[0] % 2 for r in rows)
    assert [r[0] for r in rows] != sorted(r[0] for r in rows)
    assert run(1, 0) == first[1] and run(1, 1) != first[1]


def test_a_reader_begins_again(path):
    feed = TensorFeed(path)
    whole = [o for o, _, _ in feed.read(1, 2, seed=9, epoch=2)]
    for skip in (0, 1, 57, 200, len(whole)):
        assert [o for o, _, _ in TensorFeed(path).read(1, 2, seed=9, epoch=2, skip=skip)] == whole[skip:]
    with pytest.raises(ValueError, match="shard"):
        next(feed.read(2, 2))


def test_no_tensors(spark, tmp_path):
    none = spark.createDataFrame([], "obs_idx int, features array<array<double>>, label int")
    assert len(TensorSet(none)) == 0 and list(TensorSet(none).read(seed=1)) == []
