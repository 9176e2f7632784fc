"""The same bars and waves over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE = "symbol string, direction int, extreme_at timestamp, extreme double, confirmed_at timestamp, price double"


def live_bars(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream (symbol, ts, price), each sent once its time and ``late`` have passed."""
    at = F.struct("ts", "price")
    grouped = events.withWatermark("ts", late).groupBy("symbol", F.window("ts", width))
    bars = grouped.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("n"))
    return bars.select("symbol", F.col("window.start").alias("t"), "open", "high", "low", "close", "n")


def _changes(theta: float):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, high, high_at, low, low_at, last = state.get if state.exists else (0, None, None, None, None, None)
        rows, out = pd.concat(list(batches)).sort_values("ts", kind="stable"), []  # a symbol's part of one micro-batch
        if len(rows):
            if last is not None and rows["ts"].iat[0] < last:
                raise ValueError(f"a price of {key[0]} at {rows['ts'].iat[0]} came after one at {last}")
            last = rows["ts"].iat[-1]
            for ts, price in zip(rows["ts"], rows["price"]):
                if high is None:
                    high, high_at, low, low_at = price, ts, price, ts
                    continue
                if up >= 0 and price > high:
                    high, high_at = price, ts
                if up <= 0 and price < low:
                    low, low_at = price, ts
                if up <= 0 and low_at != ts and price >= low * (1 + theta):
                    out.append((key[0], 1, low_at, low, ts, price))
                elif up >= 0 and high_at != ts and price <= high * (1 - theta):
                    out.append((key[0], -1, high_at, high, ts, price))
                else:
                    continue
                up, high, high_at, low, low_at = out[-1][1], price, ts, price, ts
        yield pd.DataFrame(out, columns=["symbol", "direction", "extreme_at", "extreme", "confirmed_at", "price"])
        state.update((up, high, high_at, low, low_at, last))

    return step


def live_changes(prices: DataFrame, theta: float) -> DataFrame:
    """Directional changes of a stream (symbol, ts, price), sent when confirmed; the same ones as
    ``waves.directional_changes`` finds in the whole table.

    The state of a symbol is its direction and running extremes; until the first change both of them run.  A micro-batch
    is put in order of time; a price from before an earlier micro-batch's last one is an error, as changes already sent may
    depend on it."""
    kept = "up int, high double, high_at timestamp, low double, low_at timestamp, last timestamp"
    return prices.groupBy("symbol").applyInPandasWithState(_changes(theta), CHANGE, kept, "append", GroupStateTimeout.NoTimeout)
