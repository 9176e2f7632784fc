"""Price bars from event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds of a bar.
HOUR = 3600


def slot(t, seconds: int = HOUR):
    """Whole steps since 1970 of a wall-clock timestamp."""
    return F.floor(F.unix_seconds(F.col(t).cast("timestamp")) / seconds).cast("long")


def resample(rows: DataFrame, symbol: str, ts: str, order: str, price: str, unit: str) -> DataFrame:
    """(symbol, t, open, high, low, close, volume, n): one bar for each symbol and ``unit`` of time.

    Open and close are the prices of the first and last row by (ts, order); volume is the sum of prices,
    rounded so that it doesn't depend on the order of addition."""
    at = F.struct(F.col(ts), F.col(order))
    bars = rows.groupBy(F.col(symbol).alias("symbol"), F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("t"))
    return bars.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.round(F.sum(price), 6).alias("volume"), F.count("*").alias("n"))


def event_bars(events: DataFrame, unit: str = "hour") -> DataFrame:
    return resample(events, "event_type", "ts", "event_id", "value", unit)


def order_bars(orders: DataFrame) -> DataFrame:
    return resample(orders, "o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice", "day")
