"""Chronological evaluation, trades and tests for many strategies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.tables import settle


def split(slot, lo, hi):
    """train, validation or test: the first 60, next 20 and last 20 percent of the span of slots."""
    span = hi - lo + 1
    return F.when((slot - lo) * 10 < span * 6, "train").when((slot - lo) * 10 < span * 8, "validation").otherwise("test")


def with_split(rows: DataFrame) -> DataFrame:
    span = rows.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    return rows.join(F.broadcast(span)).withColumn("split", split(F.col("slot"), F.col("lo"), F.col("hi"))).drop("lo", "hi")  # one row


def embargoed(rows: DataFrame, steps: int) -> DataFrame:
    """Rows with their split, without those of the last ``steps`` steps before a boundary; the embargo is taken
    from the earlier side."""
    span = rows.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    at = lambda s: split(s, F.col("lo"), F.col("hi"))
    return rows.join(F.broadcast(span)).withColumn("split", at(F.col("slot"))).where(at(F.col("slot") + steps) == F.col("split")).drop("lo", "hi")


def walk_forward(rows: DataFrame, first: int, train: int, test: int, folds: int, purge: int) -> DataFrame:
    """(fold, part, rows): expanding training from ``first``, tests of ``test`` steps, and training rows whose labels
    of ``purge`` steps reach into the test left out."""
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")
    start = F.lit(first + train) + F.col("fold") * test
    part = F.when((F.col("slot") >= start) & (F.col("slot") < start + test), "test").when((F.col("slot") >= first) & (F.col("slot") + purge < start), "train")
    return rows.select("slot", fold).withColumn("part", part).where("part IS NOT NULL").groupBy("fold", "part").agg(F.count("*").alias("rows"))


def fold_samples(rows: DataFrame, first: int, train: int, test: int, folds: int, purge: int, embargo: int) -> DataFrame:
    """rows(slot, ...) with ``fold`` and ``part``: each row once for each fold that tests it or may train on it.

    Training expands from ``first``; rows whose labels of ``purge`` steps end within ``embargo`` steps before the test, or
    later, don't train.  Nothing is shuffled: rows are multiplied where they are read."""
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))) if folds else F.explode(F.array().cast("array<int>"))
    start = F.lit(first + train) + F.col("fold") * test
    part = F.when((F.col("slot") >= start) & (F.col("slot") < start + test), "test").when((F.col("slot") >= first) & (F.col("slot") + purge + embargo < start), "train")
    return rows.withColumn("fold", fold).withColumn("part", part).where("part IS NOT NULL")


def fold_count(first: int, last: int, train: int, test: int) -> int:
    """How many tests of ``test`` steps, the last one perhaps shorter, follow the first ``train`` steps."""
    return max(0, -(-(last - first + 1 - train) // test))


def trimmed(trades: DataFrame, percent: int, by: str = "gross") -> DataFrame:
    """Trades without their best ``percent``, to see what is left without a few winners; of equal ones, those of later
    symbols and slots go first."""
    from tidemark.operators.stats import ordered

    total = trades.agg(F.count("*").alias("_all"))  # one row
    rows = ordered(trades, by, ["symbol", "slot"]).join(F.broadcast(total))
    return rows.where(F.col("place") < F.col("_all") - F.floor(F.col("_all") * percent / 100)).drop("place", "_all")


def funded(trades: DataFrame, funding: DataFrame, hold: int) -> DataFrame:
    """trades(symbol, slot, signal, ...) with ``funding``: what longs pay and shorts get at each funding time while the
    position is open, (slot, slot + hold]; funding(symbol, slot, rate).  Trades and rates meet by stretches of
    ``hold`` steps."""
    stretch = lambda c: F.floor(F.col(c) / hold)
    left = trades.select("symbol", "slot", "signal", F.explode(F.array(stretch("slot"), stretch("slot") + 1)).alias("stretch"))
    right = funding.select("symbol", F.col("slot").alias("at"), "rate", stretch("slot").alias("stretch"))
    paid = left.join(right, ["symbol", "stretch"]).where(f"at > slot AND at <= slot + {hold}").groupBy("symbol", "slot").agg(F.sum(-F.col("signal") * F.col("rate")).alias("funding"))
    return trades.join(paid, ["symbol", "slot"], "left").withColumn("funding", F.coalesce("funding", F.lit(0.0)))


def promoted(candidates: DataFrame, seen: DataFrame, key: str, least: float = 0.0) -> DataFrame:
    """Candidates whose out-of-sample expectancy in seen(key, expectancy) is above ``least``; no others may go on to a
    backtest."""
    return candidates.join(seen.where(F.col("expectancy") > least).select(key), key, "left_semi")


def purged(train: DataFrame, test: DataFrame) -> DataFrame:
    """Training labels (symbol, slot, exit_slot) that overlap no test label of their symbol.

    Intervals meet by stretches of a day, each dealt to all that it touches."""
    days = lambda f, extra: f.select("symbol", "slot", "exit_slot", F.explode(F.sequence(F.floor(F.col("slot") / 24), F.floor(F.col("exit_slot") / 24))).alias("day"), *extra)
    left, right = days(train, []), days(test, []).withColumnsRenamed({"slot": "t_slot", "exit_slot": "t_exit"})
    hit = left.join(right, ["symbol", "day"]).where("slot <= t_exit AND t_slot <= exit_slot").select("symbol", "slot", "exit_slot").distinct()
    return train.join(hit, ["symbol", "slot", "exit_slot"], "left_anti")


def trades(signals: DataFrame, bars: DataFrame, hold: int, delay: int = 0) -> DataFrame:
    """(symbol, slot, signal, gross): enter at the open ``1 + delay`` steps after the signal, leave at the open ``hold``
    steps later; signals without both bars are no trades."""
    opens = bars.select("symbol", "slot", "open")
    enter = opens.select("symbol", (F.col("slot") - 1 - delay).alias("slot"), F.col("open").alias("enter"))
    leave = opens.select("symbol", (F.col("slot") - 1 - delay - hold).alias("slot"), F.col("open").alias("leave"))
    out = signals.select("symbol", "slot", "signal").join(enter, ["symbol", "slot"]).join(leave, ["symbol", "slot"])
    return out.select("symbol", "slot", "signal", (F.col("signal") * (F.col("leave") / F.col("enter") - 1)).alias("gross"))


def net(gross, fee: float, slippage: float):
    """Return after fees and slippage on both sides."""
    return gross - 2 * (fee + slippage)


def normal_quantile(p: Column) -> Column:
    """The standard normal's quantile of p of at least one half, by the rational form 26.2.23 of Abramowitz and Stegun
    (error below 0.00045)."""
    t = F.sqrt(-2 * F.log(1 - p))
    return t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)


def normal_cdf(x: Column) -> Column:
    """The standard normal's distribution, by form 26.2.17 of Abramowitz and Stegun (error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def deflated_sharpe(returns: DataFrame) -> DataFrame:
    """(strategy, sharpe, n, deflated) of returns(strategy, r), after Bailey and López de Prado (2014): the
    probability that a Sharpe ratio exceeds what the best of so many trials would show by chance."""
    each = returns.groupBy("strategy").agg((F.avg("r") / F.stddev_samp("r")).alias("sharpe"), F.count("*").alias("n"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("excess")).where("sharpe IS NOT NULL AND n > 2")
    whole = each.agg(F.count("*").cast("double").alias("trials"), F.stddev_samp("sharpe").alias("spread"))
    euler, trials = 0.5772156649015329, F.col("trials")
    lift = F.col("spread") * ((1 - euler) * normal_quantile(1 - 1 / trials) + euler * normal_quantile(1 - 1 / (trials * 2.718281828459045)))
    s = F.col("sharpe")
    z = (s - lift) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("skew") * s + (F.col("excess") + 2) / 4 * s * s)
    return each.join(F.broadcast(whole)).where("trials > 1").select("strategy", "sharpe", "n", normal_cdf(z).alias("deflated"))  # one row


def half_masks(blocks: int) -> np.ndarray:
    """All choices of half of the blocks, as bit masks in order; 12,870 of 16 blocks."""
    masks = np.arange(1 << blocks)
    return masks[np.bitwise_count(masks) == blocks // 2]


def _half_means(sums: np.ndarray, counts: np.ndarray, masks: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(means on the chosen blocks, means on the others) of strategies by masks; NaN without rows.

    The sum over a mask is one over its low bits and one over its high bits, from tables of all subsets of either."""

    def by_mask(values: np.ndarray) -> np.ndarray:
        low = blocks // 2
        tables = []
        for part in (values[:, :low], values[:, low:]):
            table = np.zeros((len(values), 1))
            for i in range(part.shape[1]):
                table = np.concatenate([table, table + part[:, i : i + 1]], axis=1)
            tables.append(table)
        return tables[0][:, masks & ((1 << low) - 1)] + tables[1][:, masks >> low]

    s, n = by_mask(sums), by_mask(counts)
    with np.errstate(invalid="ignore", divide="ignore"):
        seen = np.where(n > 0, s / n, np.nan)
        rest = counts.sum(1, keepdims=True) - n
        unseen = np.where(rest > 0, (sums.sum(1, keepdims=True) - s) / rest, np.nan)
    missing = np.isnan(seen) | np.isnan(unseen)
    return np.where(missing, np.nan, np.round(seen, 9)), np.where(missing, np.nan, np.round(unseen, 9))


def overfitting(blocks: DataFrame, count: int, batch: int = 256) -> DataFrame:
    """(mask, best, place, of) for each choice of half of ``count`` blocks, at most 16: the strategy best on the chosen
    ones, and its place by mean return on the others, 1 the worst, among as many strategies as have rows on both sides.
    blocks(strategy, block, s, n) has sums and counts; of equal means the first strategy by name is better.

    The share of masks whose place is in the lower half is the probability of overfitting (CSCV).  A strategy is one row of
    sums.  Batches of them give their best for each mask, and then how many of them lie below the best of all; what is
    grouped is one row for each batch and mask, and the best ones that are broadcast are as many as there are masks."""
    if count % 2 or count > 16:
        raise ValueError("the number of blocks must be even, and 16 at most")
    masks = half_masks(count)
    at = lambda column: F.array(*(F.coalesce(F.sum(F.when(F.col("block") == i, F.col(column))), F.lit(0)).cast("double") for i in range(count)))
    rows = settle(blocks.groupBy("strategy").agg(at("s").alias("s"), at("n").alias("n")), "strategies")

    def means(part: pd.DataFrame):
        for i in range(0, len(part), batch):
            some = part.iloc[i : i + batch].sort_values("strategy")
            yield some["strategy"].to_numpy(), *_half_means(np.stack(some["s"]), np.stack(some["n"]), masks, count)

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for names, seen, unseen in means(part):
                top = np.where(np.isnan(seen), -np.inf, seen).argmax(0)  # the first of equal ones
                here = np.arange(len(masks))
                found = pd.DataFrame({"mask": masks, "seen": seen[top, here], "strategy": names[top], "unseen": unseen[top, here], "of": (~np.isnan(seen)).sum(0)})
                yield found[found["of"] > 0]

    order = F.struct((-F.col("seen")).alias("seen"), "strategy", "unseen")
    tops = rows.mapInPandas(best, "mask long, seen double, strategy string, unseen double, of long").groupBy("mask").agg(F.min(order).alias("b"), F.sum("of").alias("of"))
    tops = settle(tops.select("mask", F.col("b.strategy").alias("best"), F.col("b.unseen").alias("unseen"), "of"), "best")
    every = tops.agg(F.collect_list(F.struct("mask", "best", "unseen")).alias("tops"))  # as many as masks

    def below(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            known = {x["mask"]: x for x in part["tops"].iat[0]}
            mine = np.array([mask in known for mask in masks])
            limit = np.array([known[m]["unseen"] if m in known else np.nan for m in masks])
            name = np.array([known[m]["best"] if m in known else "" for m in masks], dtype=object)
            for names, _, unseen in means(part):
                less = (unseen < limit) | (unseen == limit) & (names[:, None] < name[None, :])
                yield pd.DataFrame({"mask": masks[mine], "below": less.sum(0)[mine]})

    counts = rows.join(F.broadcast(every)).mapInPandas(below, "mask long, below long").groupBy("mask").agg(F.sum("below").alias("below"))
    return tops.join(counts, "mask").select("mask", "best", (F.col("below") + 1).alias("place"), "of")
