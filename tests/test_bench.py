"""The bench, and sessions without a shared folder, each in a process of its own."""

import json
import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def process(code, **env):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={**os.environ, **env}, capture_output=True, text=True, timeout=300)


def test_bench():
    done = process("import bench; bench.main(['bars_ohlcv', 'bar_quality'], 20_000)", BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2")
    assert done.returncode == 0, done.stderr[-2000:]
    out = json.loads(done.stdout.strip().splitlines()[-1])
    assert set(out["queries"]) == {"bars_ohlcv", "bar_quality"} and out["quality_scan_20000"] > 0 and out["sf"] == "sf0.001"


def test_a_session_without_a_shared_folder(tmp_path):
    """On one machine, written tables go to a local folder; elsewhere they are refused."""
    code = """
from pyspark.sql import SparkSession
from tidemark.plans.tables import settle
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert settle(spark.range(3), "three").count() == 3 == settle(spark.range(3), "three").count()
"""
    done = process(code, SPARK_CONF_DIR=str(tmp_path))
    assert done.returncode == 0, done.stderr[-2000:]
    from tidemark.plans.tables import settle

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="set spark.checkpoint.dir"):
        settle(SimpleNamespace(sparkSession=session), "three")
