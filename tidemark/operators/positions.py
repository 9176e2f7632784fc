"""Positions that exclude each other: a symbol takes the next trade only once the one before is closed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import states_before
from tidemark.operators.series import indexed
from tidemark.plans.tables import settle

#: Trades of a chunk.
CHUNK = 4096


def _following(slots: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """The first trade of the chunk that may follow each one."""
    return np.maximum(np.searchsorted(slots, exits), np.arange(1, len(slots) + 1))


def _joined(pairs: list[tuple[float, float]]) -> list[float]:
    """A step function as [limit, end, ...]: free up to a limit, it is free again at the end; beyond the last limit it stays
    as it is.  Steps of equal ends are one."""
    kept = [pair for pair, after in zip(pairs, [*pairs[1:], None]) if after is None or after[1] != pair[1]]
    return [float(x) for pair in kept for x in pair]


def _waits(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """When a chunk leaves the symbol free, by when it was free before: trades are taken from the first possible one on."""
    rows = rows.sort_values("idx")
    slots, exits = rows["slot"].to_numpy(), rows["exit_slot"].to_numpy()
    ends = [0] * len(rows)
    for i, after in reversed(list(enumerate(_following(slots, exits).tolist()))):
        ends[i] = ends[after] if after < len(rows) else int(exits[i])
    return pd.DataFrame([(*key, _joined(list(zip(slots.tolist(), ends))))], columns=["symbol", "place", "f"])


def _free_after(f, state) -> list[float]:
    step = int(np.searchsorted(f[0::2], state[0]))
    return [float(f[2 * step + 1])] if 2 * step < len(f) else [float(state[0])]


def _composed(f, g) -> list[float]:
    own = [(limit, _free_after(g, [end])[0]) for limit, end in zip(f[0::2], f[1::2])]
    return _joined(own + [(limit, end) for limit, end in zip(g[0::2], g[1::2]) if not own or limit > own[-1][0]])


def _taken(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("idx")
    slots, exits = rows["slot"].to_numpy(), rows["exit_slot"].to_numpy()
    after, taken = _following(slots, exits), []
    at = int(np.searchsorted(slots, rows["state"].iloc[0][0]))
    while at < len(rows):
        taken.append(at)
        at = int(after[at])
    return pd.DataFrame({"symbol": key[0], "idx": rows["idx"].to_numpy()[taken]})


def exclusive(trades: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """Trades(symbol, slot, exit_slot, ...) that one position a symbol takes in turn: the first one, and then always the
    first that begins at or after the exit before; of trades that begin at once the first by ``tie``.

    A chunk of trades tells when it leaves the symbol free, for any time from which it is free; a scan over the chunks
    then gives each the true time, so that a symbol with most trades is spread over tasks.  Trades leave at their own
    slot at the earliest; no trades give none."""
    rows = indexed(trades.withColumn("_t", F.timestamp_seconds(F.col("slot") * 3600)), t="_t", tie=tie).withColumn("place", F.floor(F.col("idx") / CHUNK)).drop("_t")
    rows = settle(rows, "trades")
    narrow = rows.select("symbol", "place", "idx", "slot", "exit_slot")
    functions = settle(narrow.groupBy("symbol", "place").applyInPandas(_waits, "symbol string, place long, f array<double>"), "waits")
    last = functions.agg(F.max("place")).first()[0] or 0
    states = states_before(functions, ["symbol"], last, _composed, _free_after, [-math.inf])
    taken = narrow.join(states, ["symbol", "place"]).groupBy("symbol", "place").applyInPandas(lambda key, part: _taken(key, part), "symbol string, idx long")
    return rows.join(taken, ["symbol", "idx"], "left_semi").drop("idx", "place")
