"""Tables cut from their lineage, in the folder that all executors share."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a batch that goes to a Python worker, at most: batches hold whole texts.
BATCH_ROWS = 1000


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset on a single machine, a local one of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _local_folder()
    return found.rstrip("/")


#: Paths of the tables cut so far by the innermost ``settled`` that runs.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


#: Spark keeps shuffle files until the driver happens to collect its garbage; with this they go when a write has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """A setting of the session meanwhile; then it is as it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def tidy_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of what is written meanwhile are deleted once it is written."""
    return setting(spark, _CLEANUP, True)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(frame: DataFrame, name: str, batch: int = BATCH_ROWS) -> DataFrame:
    """The same rows, written to the shared folder and read again: computed once, and safe when executors are lost.

    ``batch``: rows of a batch that goes to a Python worker meanwhile; more suit short rows."""
    spark = frame.sparkSession
    small_batches(spark, batch)
    try:
        path = new_path(spark, name)
        if (passing := _passing.get()) is not None:
            passing.append(path)
        with tidy_shuffles(spark):
            frame.write.parquet(path)
    finally:
        small_batches(spark)
    return spark.read.schema(frame.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame], batch: int = BATCH_ROWS) -> DataFrame:
    """The rows of make(), cut; tables that make() has cut on the way are deleted then, and also if it fails.

    make() must not hand out a frame that reads them in another way than by what it returns."""
    own: list[str] = []
    before = _passing.set(own)
    try:
        frame = make()
        _passing.reset(before)
        before = None
        return cut(frame, name, batch)
    finally:
        if before:
            _passing.reset(before)
        for path in own:
            delete(spark, path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Sets the session's Arrow batches to so many rows: the default of 10,000 whole texts is much for a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def fresh(frame: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame doesn't have, whatever the case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(frame: DataFrame, key: str) -> tuple[DataFrame, str]:
    """(the same rows, the name of a column that tells each from all others): ``key`` where it does, and else a new
    column, written so that it stays as it is."""
    if frame.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).isEmpty():
        return frame, key
    name = fresh(frame, "_row")
    return cut(frame.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def lean(function):
    """``function``, which maps batches; what Arrow's pool and the C library keep of them goes back to the system once a
    task has ended.

    Workers are used again, so a worker would hold that through all jobs that follow."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def through(frame: DataFrame, function, key: str, schema: str) -> DataFrame:
    """mapInPandas by ``lean``, with the column ``key`` carried as text: beside nulls, pandas would make integers floats."""
    small_batches(frame.sparkSession)
    kind = frame.schema[key].dataType
    return frame.withColumn(key, F.col(key).cast("string")).mapInPandas(lean(function), f"{key} string, {schema}").withColumn(key, F.col(key).cast(kind))


#: Rows of a broadcast filter on hashed keys, at most.
FILTER_BUCKETS = 1 << 20


def split_by(frame: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``frame`` whose key may be among ``keys``, and rows whose key surely isn't (null keys too).

    A filter of at most FILTER_BUCKETS hash buckets is broadcast, so that a join with few keys needn't move
    all the rows of ``frame``.  With many keys it lets more rows through; the join that follows is exact.
    """
    name = fresh(frame, "_bucket")
    bucket = F.pmod(F.xxhash64(key), F.lit(FILTER_BUCKETS)).cast("int")
    marks = F.broadcast(keys.where(F.col(key).isNotNull()).select(bucket.alias(name)).distinct())
    tagged = frame.withColumn(name, F.when(F.col(key).isNotNull(), bucket).otherwise(-1))
    return tagged.join(marks, name, "left_semi").drop(name), tagged.join(marks, name, "left_anti").drop(name)


def without(frame: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``frame`` whose key isn't among ``keys``; rows with a null key stay."""
    near, rest = split_by(frame, keys, key)
    return near.join(keys.select(key).distinct(), key, "left_anti").select(frame.columns).unionByName(rest.select(frame.columns))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) edges: (node, component), the smallest node of each.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), so that long chains take few
    rounds.  Neighbour lists are never gathered: each step is a minimum by node, partly taken where the rows are,
    and a join back.  The minima are written before they are joined, so that both sides of the join are plain
    exchanges and Spark can split the rows of a node that has very many neighbours.
    Edges from a node to itself and repeated edges are harmless; no edges give no rows.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u")
        links = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
