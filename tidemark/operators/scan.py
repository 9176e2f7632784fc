"""Scans over chunks of ordered rows, of states that depend on all rows before.

A chunk tells what it does to any state, as a function that is written as a flat array of numbers.  Functions of
neighbouring chunks are composed FAN at a time, level by level, until one group is left for each key, and the states
before the chunks are handed down again.  No task holds more than FAN functions, and the levels are few: the logarithm,
to the base FAN, of the number of chunks.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.tables import settle

#: Functions that are composed at a time.
FAN = 64
Numbers = list[float]


def _composed(names: list[str], compose: Callable[[Numbers, Numbers], Numbers]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for f in rows.sort_values("place")["f"]:
            whole = f if whole is None else compose(whole, f)
        return pd.DataFrame([(*key, [float(x) for x in whole])], columns=[*names, "place", "f"])

    return run


def _handed_down(names: list[str], after: Callable[[Numbers, Numbers | None], Numbers]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("place"), []
        state = rows["state"].iloc[0]
        for *key, place, f in rows[[*names, "place", "f"]].itertuples(index=False):
            out.append((*key, place, None if state is None else [float(x) for x in state]))
            state = after(f, state)
        return pd.DataFrame(out, columns=[*names, "place", "state"])

    return run


def states_before(functions: DataFrame, key: list[str], last: int, compose: Callable[[Numbers, Numbers], Numbers], after: Callable[[Numbers, Numbers | None], Numbers], begin: Numbers | None = None) -> DataFrame:
    """(*key, place, state): the state before each chunk of functions(*key, place, f), places being 0 to ``last``, not all
    of which need be there; ``begin`` is the state before a key's first chunk.

    compose(f, g) is the function that does f and then g, after(f, state) the state after a chunk."""
    keys = ", ".join(f"{c} {functions.schema[c].dataType.simpleString()}" for c in key)
    group = F.floor(F.col("place") / FAN)
    levels = [functions.select(*key, "place", "f")]
    while last >= FAN:
        last //= FAN
        levels.append(settle(levels[-1].groupBy(*key, group.alias("group")).applyInPandas(_composed(key, compose), f"{keys}, place long, f array<double>"), "composed"))
    state = F.lit(None).cast("array<double>") if begin is None else F.array(*(F.lit(float(x)) for x in begin))
    down, schema = _handed_down(key, after), f"{keys}, place long, state array<double>"
    out = levels.pop().withColumn("state", state).groupBy(*key).applyInPandas(down, schema)
    for level in reversed(levels):
        above = out.select(*key, F.col("place").alias("group"), "state")
        out = level.withColumn("group", group).join(above, [*key, "group"]).groupBy(*key, "group").applyInPandas(down, schema)
    return out
