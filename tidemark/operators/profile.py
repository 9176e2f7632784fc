"""Quality and coverage of regularly sampled series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import negative_cells, ohlc_violation
from tidemark.operators.series import indexed, windowed


def steps(bars: DataFrame) -> DataFrame:
    """bars(symbol, t, slot) with ``diff``, the steps since the symbol's row before; null on its first."""
    return windowed(bars, {"diff": lambda w: F.col("slot") - F.lag("slot").over(w)}, 1)


def bar_quality(bars: DataFrame) -> DataFrame:
    """One row a symbol: rows, duplicates, disorder, gaps, missing steps, price checks and the range of closes."""
    return steps(bars).groupBy("symbol").agg(
        F.count("*").alias("rows"), (F.count("*") - F.count_distinct("slot")).alias("duplicates"), F.count_if(F.col("diff") <= 0).alias("non_monotonic"), F.count_if(F.col("diff") > 1).alias("gaps"),
        F.coalesce(F.sum(F.when(F.col("diff") > 1, F.col("diff") - 1)), F.lit(0)).alias("missing"), F.count_if(ohlc_violation(*(F.col(c) for c in ("open", "high", "low", "close")))).alias("ohlc_violations"),
        F.sum(negative_cells(*(F.col(c) for c in ("open", "high", "low", "close", "volume")))).alias("negative_values"), F.count_if(F.col("volume") == 0).alias("zero_volume"), F.min("close").alias("min_close"), F.max("close").alias("max_close"),
    )


def calendar(bars: DataFrame) -> DataFrame:
    """(symbol, slot) of every step between the first and last of the whole table, for each symbol."""
    span = bars.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    return bars.select("symbol").distinct().join(F.broadcast(span)).select("symbol", F.explode(F.sequence("lo", "hi")).alias("slot"))  # span: one row


def missing_slots(bars: DataFrame) -> DataFrame:
    return calendar(bars).join(bars.select("symbol", "slot"), ["symbol", "slot"], "left_anti")


def coverage(bars: DataFrame) -> DataFrame:
    """One row a symbol: first and last step, steps present, expected and missing."""
    have = bars.groupBy("symbol").agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("present"))
    span = bars.agg((F.max("slot") - F.min("slot") + 1).alias("expected"))
    return have.join(F.broadcast(span)).withColumn("missing", F.col("expected") - F.col("present"))


def runs(rows: DataFrame) -> DataFrame:
    """(symbol, start, end, length) of runs of consecutive slots; rows(symbol, t, slot) without duplicates.

    slot minus index is constant along a run, so runs are groups, summed before they are shuffled."""
    island = indexed(rows).withColumn("island", F.col("slot") - F.col("idx"))
    return island.groupBy("symbol", "island").agg(F.min("slot").alias("start_slot"), F.max("slot").alias("end_slot"), F.count("*").alias("length")).drop("island")


def largest_gaps(bars: DataFrame, k: int) -> DataFrame:
    """The k longest gaps of each symbol, earlier ones first among equals."""
    gaps = steps(bars).where("diff > 1").select("symbol", F.col("slot").alias("resumes"), (F.col("diff") - 1).alias("gap"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("gap"), "resumes"))  # each task keeps k rows a symbol first
    return gaps.withColumn("place", rank).where(F.col("place") <= k)
