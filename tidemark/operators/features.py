"""A feature table from a registry: what each feature is made of, how far it looks back, and when it is known.

Features of bounded frames are made in one pass over one ordering, whatever their number: the planner takes the longest
frame as the halo of the chunks.  Recursive ones (exponential means, average true range, relative strength) depend on all
bars before; a chunk is an affine function of the value at its start, so a scan over the chunks gives each its start, and
the same pass then carries it on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import states_before
from tidemark.operators.series import chunked, indexed
from tidemark.plans.tables import settle


@dataclass(frozen=True)
class Feature:
    """``before``: rows that it looks back; ``make``: a column, of the ordered window; ``alpha``: instead, the recursive mean
    of the input that ``make`` gives, with that weight of the newest; ``known``: steps after its bar's at which it may be used."""

    before: int
    make: Callable[[object], Column]
    alpha: float | None = None
    known: int = 1


def _frame(w, n: int):
    return w.rowsBetween(1 - n, 0)


def _moved(w, sign: int) -> Column:
    """How far the close rose (or fell) from the one before; null for a first bar."""
    change = sign * (F.col("close") - F.lag("close").over(w))
    return F.when(change.isNotNull(), F.greatest(change, F.lit(0.0)))


def _true_range(w) -> Column:
    before = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


#: Families by name, each made for every length of LENGTHS.
FAMILIES: dict[str, Callable[[int], Feature]] = {
    "momentum": lambda n: Feature(n, lambda w: F.round(F.try_divide("close", F.lag("close", n).over(w)) - 1, 9)),
    "mean": lambda n: Feature(n, lambda w: F.round(F.avg("close").over(_frame(w, n)), 6)),
    "deviation": lambda n: Feature(n, lambda w: F.round(F.stddev_samp("close").over(_frame(w, n)), 6)),
    "range": lambda n: Feature(n, lambda w: F.round(F.max("high").over(_frame(w, n)) - F.min("low").over(_frame(w, n)), 6)),
    "place": lambda n: Feature(n, lambda w: F.round(F.try_divide(F.col("close") - F.min("low").over(_frame(w, n)), F.max("high").over(_frame(w, n)) - F.min("low").over(_frame(w, n))), 6)),
    "volume_share": lambda n: Feature(n, lambda w: F.round(F.try_divide("volume", F.sum("volume").over(_frame(w, n))), 9)),
    "events": lambda n: Feature(n, lambda w: F.sum("n").over(_frame(w, n))),
    "rises": lambda n: Feature(n + 1, lambda w: F.sum(F.when(F.col("close") > F.col("open"), 1).otherwise(0)).over(_frame(w, n))),
}
LENGTHS = (3, 6, 12, 24)
REGISTRY: dict[str, Feature] = {
    **{f"{name}_{n}": make(n) for name, make in FAMILIES.items() for n in LENGTHS},
    **{f"ema_{n}": Feature(1, lambda w: F.col("close"), 2 / (n + 1)) for n in (6, 12, 26)},
    "atr_14": Feature(1, _true_range, 1 / 14),
    "gain_14": Feature(1, lambda w: _moved(w, 1), 1 / 14),
    "loss_14": Feature(1, lambda w: _moved(w, -1), 1 / 14),
}


def _carried(values: pd.Series, alpha: float, start: float | None) -> np.ndarray:
    """Recursive means; without a start the first value is one.  Missing values change nothing."""
    begun = start is not None and not np.isnan(start)
    every = pd.concat([pd.Series([start]), values]) if begun else values
    return every.astype(float).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()[int(begun) :]


def _affine(alphas: list[float], names: list[str]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """What a chunk does to the values at its start: each becomes a x + b."""
        rows, f = rows.sort_values("idx"), []
        for alpha, name in zip(alphas, names):
            values = rows[name]
            first, some = key[1] == 0, int(values.notna().sum())
            f += [0.0 if first else (1 - alpha) ** some, float(_carried(values, alpha, None if first else 0.0)[-1])]
        return pd.DataFrame([(*key, f)], columns=["symbol", "place", "f"])

    return run


def _composed(f, g) -> list[float]:
    out = []
    for a, b, c, d in zip(f[0::2], f[1::2], g[0::2], g[1::2]):
        out += [a * c, c * b + d]
    return out


def _after(f, state) -> list[float]:
    return [a * x + b if a else b for a, b, x in zip(f[0::2], f[1::2], state)]


def _finished(alphas: list[float], names: list[str]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", kind="stable")
        head = rows["_start"].notna().to_numpy()
        own = rows[~head & ~rows["_halo"].to_numpy(bool)].copy()
        start = rows["_start"][head].iloc[0] if head.any() and key[1] > 0 else [None] * len(names)
        for alpha, name, x in zip(alphas, names, start):
            own[name] = _carried(own[name], alpha, x)
        return own.drop(columns=["_start", "_halo", "_chunk", "idx"])

    return run


def feature_table(bars: DataFrame, registry: dict[str, Feature] = REGISTRY, keep: tuple[str, ...] = ("symbol", "slot")) -> DataFrame:
    """(*keep, known_at, every feature of the registry) of each bar(symbol, slot, t, ...).

    known_at is the slot from which all of a row's features may be used.  Rows are shuffled once for all features, and
    before that once, with the recursive features' inputs alone, to find where the recursions stand at each chunk."""
    plain = {name: f for name, f in registry.items() if f.alpha is None}
    recursive = {name: f for name, f in registry.items() if f.alpha is not None}
    alphas, names = [f.alpha for f in recursive.values()], list(recursive)
    before = max([1, *(f.before for f in registry.values())])
    known = max([0, *(f.known for f in registry.values())])
    rows = settle(indexed(bars), "ordered")
    dealt, window = chunked(rows, before)
    if recursive:
        near, place = chunked(rows, 1)
        inputs = near.withColumns({name: f.make(place).cast("double") for name, f in recursive.items()}).where("NOT _halo").select("symbol", F.col("_chunk").alias("place"), "idx", *names)
        functions = settle(inputs.groupBy("symbol", "place").applyInPandas(_affine(alphas, names), "symbol string, place long, f array<double>"), "affine")
        last = functions.agg(F.max("place")).first()[0] or 0
        states = states_before(functions, ["symbol"], last, _composed, _after, [0.0] * len(names))
        # A chunk's start is one more row of it, before all others: a join would move the rows again
        heads = states.select("symbol", F.col("place").alias("_chunk"), F.lit(-1).cast("long").alias("idx"), F.lit(False).alias("_halo"), F.col("state").alias("_start"))
        dealt = dealt.withColumn("_start", F.lit(None).cast("array<double>")).unionByName(heads, allowMissingColumns=True)
    columns = {name: f.make(window).cast("double") if f.alpha is not None else f.make(window) for name, f in registry.items()}
    made = dealt.withColumns(columns).withColumn("known_at", F.col("slot") + known).select("symbol", "_chunk", "idx", "_halo", *(["_start"] if recursive else []), *(c for c in keep if c != "symbol"), "known_at", *registry)
    if recursive:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema if f.name not in ("_chunk", "idx", "_halo", "_start"))
        made = made.groupBy("symbol", "_chunk").applyInPandas(_finished(alphas, names), schema)
    else:
        made = made.where("NOT _halo")
    return made.select(*keep, "known_at", *(F.round(name, 6).alias(name) if name in recursive else name for name in registry))
