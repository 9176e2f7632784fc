"""Reading tables, and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def settled_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset on a single machine, a local folder of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_folder()
    return root.rstrip("/")


def settle(frame: DataFrame, name: str) -> DataFrame:
    """The same rows, written below ``settled_root`` and read again."""
    path = f"{settled_root(frame.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
