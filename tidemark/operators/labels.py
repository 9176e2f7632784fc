"""Forward labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forward_return(bars: DataFrame, h: int) -> DataFrame:
    """(symbol, slot, ret) of the close h steps later, null where that bar is missing: rows may have gaps, so h
    steps aren't h rows."""
    later = bars.select("symbol", (F.col("slot") - h).alias("slot"), F.col("close").alias("later"))
    return bars.select("symbol", "slot", "close").join(later, ["symbol", "slot"], "left").select("symbol", "slot", F.round(F.col("later") / F.col("close") - 1, 9).alias("ret"))


def triple_barrier(events: DataFrame, bars: DataFrame, up: float, down: float, horizon: int, unit: str | None = None) -> DataFrame:
    """(symbol, slot, barrier, exit_slot): which barrier the bars of the next ``horizon`` steps reach first.

    -1 at entry * (1 - down), also where one bar reaches both; 1 at entry * (1 + up); 0 at the horizon.
    ``unit``: a column of events that scales both widths, as a relative sigma; where it is null no barrier is reached.
    Events and bars meet by stretches of ``horizon`` steps, each event in its own and the next."""
    own = F.floor(F.col("slot") / horizon)
    left = events.select("symbol", F.col("slot").alias("event"), F.col("close").alias("entry"), (F.col(unit) if unit else F.lit(1.0)).alias("unit"), F.explode(F.array(own, own + 1)).alias("stretch"))
    right = bars.select("symbol", F.col("slot").alias("at"), "high", "low", own.alias("stretch"))
    outcome = F.when(F.col("low") <= F.col("entry") * (1 - down * F.col("unit")), -1).when(F.col("high") >= F.col("entry") * (1 + up * F.col("unit")), 1)
    hits = left.join(right, ["symbol", "stretch"]).where(f"at > event AND at <= event + {horizon}").withColumn("outcome", outcome).where("outcome IS NOT NULL")
    first = hits.groupBy("symbol", F.col("event").alias("slot")).agg(F.min_by("outcome", "at").alias("hit"), F.min("at").alias("hit_slot"))
    out = events.select("symbol", "slot").join(first, ["symbol", "slot"], "left")
    return out.select("symbol", "slot", F.coalesce("hit", F.lit(0)).alias("barrier"), F.coalesce("hit_slot", F.col("slot") + horizon).alias("exit_slot"))
