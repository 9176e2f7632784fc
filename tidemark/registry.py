"""Experiments and hypotheses, kept as append-only Parquet."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "experiment string, registered_at timestamp, exploratory boolean, config_hash string, config string, data_version string, result_hash string"


@dataclass(frozen=True)
class Config:
    """Parameters of a study; fees and barriers are choices of this library."""

    symbols: tuple[str, ...] = ()
    window: tuple[str, str] = ("2024-01-01", "2024-01-31")
    thetas: tuple[float, ...] = (0.3, 0.6, 0.9)
    fee: float = 0.0005
    slippage: float = 0.0001
    embargo_steps: int = 24
    holdout_from: str | None = None
    extra: dict = field(default_factory=dict)

    def inside(self, rows: DataFrame, t: str) -> DataFrame:
        """Rows of the window, both days inclusive; a plain predicate on the column, so that scans can use it."""
        start, end = (F.lit(x).cast("date") for x in self.window)
        return rows.where((F.col(t) >= start.cast("timestamp_ntz")) & (F.col(t) < F.date_add(end, 1).cast("timestamp_ntz")))

    def parts(self, rows: DataFrame, t: str) -> DataFrame:
        """rows with ``part``: holdout from ``holdout_from`` on, which no study may use, and research before."""
        late = F.lit(False) if self.holdout_from is None else F.col(t) >= F.lit(self.holdout_from).cast("date").cast("timestamp_ntz")
        return rows.withColumn("part", F.when(late, "holdout").otherwise("research"))

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def result_hash(frame: DataFrame) -> str:
    """A digest of a result's rows in any order: equal results have equal digests, repeated rows counted.

    Row digests are summed as two 32-bit halves, so nothing is gathered."""
    row = F.sha2(F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    sums = frame.agg(F.count("*"), *(part(i) for i in range(4))).first()
    return hashlib.sha256(json.dumps([str(x) for x in sums]).encode()).hexdigest()


def register(spark: SparkSession, path: str, experiment: str, config: Config, result: DataFrame, data_version: str, exploratory: bool = False) -> None:
    row = spark.createDataFrame([(experiment, exploratory, config.digest(), json.dumps(asdict(config), sort_keys=True), data_version, result_hash(result))], "experiment string, exploratory boolean, config_hash string, config string, data_version string, result_hash string")
    row.withColumn("registered_at", F.current_timestamp()).select(*(c.split()[0] for c in SCHEMA.split(", "))).write.mode("append").parquet(path)


def trials(spark: SparkSession, path: str) -> int:
    """How many experiments were ever registered."""
    return spark.read.schema(SCHEMA).parquet(path).count()


def preregistered(spark: SparkSession, path: str, tested: DataFrame) -> DataFrame:
    """tested(experiment, tested_at) with ``confirmatory``: whether the experiment was registered as such before it was
    tested; of an experiment registered twice the first time counts."""
    known = spark.read.schema(SCHEMA).parquet(path).where("NOT exploratory").groupBy("experiment").agg(F.min("registered_at").alias("_at"))
    return tested.join(known, "experiment", "left").withColumn("confirmatory", F.coalesce(F.col("_at") <= F.col("tested_at"), F.lit(False))).drop("_at")


def locked_test(spark: SparkSession, path: str, experiment: str, config: Config, run, data_version: str) -> DataFrame:
    """The result of ``run()``, registered with its digest; refuses an experiment that was run before."""
    from pyspark.errors import AnalysisException

    try:
        if not spark.read.schema(SCHEMA).parquet(path).where(F.col("experiment") == experiment).isEmpty():
            raise ValueError(f"the locked test of {experiment} was run before")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    result = run()
    register(spark, path, experiment, config, result, data_version)
    return result
