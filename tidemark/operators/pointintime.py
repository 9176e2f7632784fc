"""Point-in-time joins and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import carried, windowed


def as_of(left: DataFrame, right: DataFrame, value: str, name: str, strict: bool = False) -> DataFrame:
    """left(symbol, t, ...) with the value of the latest right(symbol, t, value) at or before t; strict: before t.

    Rows of both sides are ordered together, and the last value is carried on.  A null value counts as none."""
    first, second = (1, 0) if strict else (0, 1)
    columns = [c for c in left.columns if c not in ("symbol", "t")]
    rows = left.select("symbol", "t", F.lit(1 - first).alias("_kind"), F.struct(*columns).alias("_left"), F.lit(None).cast(right.schema[value].dataType).alias("_right")) if columns else None
    events = right.select("symbol", "t", F.lit(1 - second).alias("_kind"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), F.col(value).alias("_right"))
    out = carried(rows.unionByName(events), F.col("_right"), name, ["_kind"])
    return out.where("_left IS NOT NULL").select("symbol", "t", "_left.*", name)


def breakout(bars: DataFrame, n: int) -> DataFrame:
    """prev_high and prev_low of the n rows before, and 1, -1 or 0 where the close is above, below or within."""
    out = windowed(bars, {"prev_high": lambda w: F.max("high").over(w.rowsBetween(-n, -1)), "prev_low": lambda w: F.min("low").over(w.rowsBetween(-n, -1))}, n)
    return out.withColumn("signal", F.when(F.col("close") > F.col("prev_high"), 1).when(F.col("close") < F.col("prev_low"), -1).otherwise(0))


def sigma(bars: DataFrame, n: int) -> DataFrame:
    """Sample deviation of the closes of the n rows before, rounded to nine places."""
    return windowed(bars, {"sigma": lambda w: F.round(F.stddev_samp("close").over(w.rowsBetween(-n, -1)), 9)}, n)


def tainted(bars: DataFrame, flag: str, n: int) -> DataFrame:
    """Whether a row or one of the n rows before it is flagged."""
    return windowed(bars, {"tainted": lambda w: F.max(F.col(flag).cast("int")).over(w.rowsBetween(-n, 0)) == 1}, n)


def transitions(bars: DataFrame, label: str) -> DataFrame:
    """Rows whose label differs from that of the row before, with both."""
    out = windowed(bars, {"before": lambda w: F.lag(label).over(w)}, 1)
    return out.where(F.col("before").isNotNull() & (F.col("before") != F.col(label)))


#: Features by name: how many rows back each looks, and how it is made from an ordered window.  All are known at
#: the close of their own bar.
FEATURES = {
    "momentum_6": (6, lambda w: F.round(F.col("close") / F.lag("close", 6).over(w) - 1, 9)),
    "mean_12": (12, lambda w: F.round(F.avg("close").over(w.rowsBetween(-11, 0)), 9)),
    "range_12": (12, lambda w: F.max("high").over(w.rowsBetween(-11, 0)) - F.min("low").over(w.rowsBetween(-11, 0))),
    "volume_share_24": (24, lambda w: F.round(F.col("volume") / F.sum("volume").over(w.rowsBetween(-23, 0)), 9)),
}


def features(bars: DataFrame, registry=FEATURES) -> DataFrame:
    """bars with every feature of the registry, from one pass over one ordering."""
    return windowed(bars, {name: make for name, (_, make) in registry.items()}, max(n for n, _ in registry.values()))


def truncation_failures(bars: DataFrame, cut_slot: int, registry=FEATURES) -> DataFrame:
    """Rows up to ``cut_slot`` whose features change once later rows are known; none, if nothing looks ahead."""
    names = list(registry)
    full, part = features(bars, registry).where(F.col("slot") <= cut_slot), features(bars.where(F.col("slot") <= cut_slot), registry)
    both = full.select("symbol", "slot", F.struct(*names).alias("x")).join(part.select("symbol", "slot", F.struct(*names).alias("y")), ["symbol", "slot"], "full_outer")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select("symbol", "slot")
