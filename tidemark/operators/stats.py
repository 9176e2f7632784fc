"""Ranks, tables and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import accumulated

#: Ranges into which a global order is cut, at least; and rows sampled for each, to find the ranges' limits.
RANGES, SAMPLED = 64, 64


def ordered(frame: DataFrame, value: str, tie: list[str]) -> DataFrame:
    """frame with ``place``, each row's place by (value, tie) among all rows, from 0.

    Rows are numbered within ranges of (value, tie), and the ranges' bases are sums of their counts, so no task sorts
    the whole table, nor all rows of a frequent value.  Limits come from a sample by hash; there are as many ranges as
    the session has shuffle partitions, or RANGES."""
    ranges = max(RANGES, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(value, *tie)
    sample = frame.select(key.alias("_key")).orderBy(F.xxhash64("_key"), "_key").limit(SAMPLED * ranges)
    some = sample.agg(F.array_sort(F.collect_list("_key")).alias("_some"))  # SAMPLED * ranges rows
    limits = some.select(F.expr(f"transform(sequence(1, {ranges - 1}), i -> try_element_at(_some, cast(floor(i * size(_some) / {ranges}) as int) + 1))").alias("_limits"))
    rows = frame.join(F.broadcast(limits)).withColumn("_range", F.size(F.filter("_limits", lambda x: x < key))).drop("_limits")  # one row
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))  # one row a range
    base = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_range").orderBy(value, *tie)
    return rows.withColumn("_at", F.row_number().over(own)).join(F.broadcast(base), "_range").withColumn("place", F.col("_base") + F.col("_at") - 1).drop("_range", "_at", "_base")


def ntiles(frame: DataFrame, value: str, tie: list[str], tiles: int, name: str) -> DataFrame:
    """frame with the tile of each row, 1 to ``tiles``, the first ones larger by one row as ntile has them."""
    total = frame.agg(F.count("*").alias("_all"))
    small, extra = F.floor(F.col("_all") / tiles), F.col("_all") % tiles
    tile = F.when(F.col("place") < extra * (small + 1), F.floor(F.col("place") / (small + 1))).otherwise(extra + F.floor((F.col("place") - extra * (small + 1)) / F.greatest(small, F.lit(1)))) + 1
    return ordered(frame, value, tie).join(F.broadcast(total)).withColumn(name, tile.cast("int")).drop("_all", "place")  # total: one row


def average_ranks(frame: DataFrame, value: str, tie: list[str], name: str) -> DataFrame:
    ranks = ordered(frame, value, tie)
    mean = ranks.groupBy(value).agg((F.avg("place") + 1).alias(name))
    return frame.join(mean, value)


def rank_correlation(frame: DataFrame, x: str, y: str, tie: list[str]) -> DataFrame:
    both = average_ranks(average_ranks(frame, x, tie, "_rx"), y, tie, "_ry")
    return both.agg(F.count("*").alias("n"), F.round(F.corr("_rx", "_ry"), 9).alias("ic"))


def merged_intervals(rows: DataFrame, events=None) -> DataFrame:
    """(symbol, start_slot, end_slot, events) of overlapping or touching intervals; rows(symbol, t, slot, end_slot).

    ``events``: what is counted, rows unless given."""
    reach = accumulated(rows, "end_slot", "reach", F.max, ["slot"], inclusive=False)
    fresh = reach.withColumn("fresh", F.when(F.col("reach").isNull() | (F.col("slot") > F.col("reach")), 1).otherwise(0)).drop("reach")
    group = accumulated(fresh, "fresh", "cluster", F.sum, ["slot"])
    return group.groupBy("symbol", "cluster").agg(F.min("slot").alias("start_slot"), F.max("end_slot").alias("end_slot"), (F.count("*") if events is None else events).alias("events")).drop("cluster")


def block_bootstrap(blocks: DataFrame, replicates: int) -> DataFrame:
    """(rep, mean): means of as many blocks(block, s, n) as there are, drawn with replacement.

    block is 0, 1, ...; draw i of replicate r is (a r + b i + c) mod p mod blocks, the same on any engine."""
    total = blocks.agg(F.count("*").alias("m"))
    draws = total.select(F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"), "m").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    drawn = draws.select("rep", F.expr("(1103515245L * rep + 12345L * i * i + 6700417L * (rep + 1) * i + 97L) % 2147483647L % m").alias("block"))
    return drawn.join(blocks, "block").groupBy("rep").agg(F.round(F.sum("s") / F.sum("n"), 9).alias("mean"))


def stationary_draws(periods: DataFrame, replicates: int, mean_block: int) -> DataFrame:
    """(rep, block, times): how often each of the periods 0 to m - 1 is drawn by each replicate of the stationary bootstrap
    of Politis and Romano (1994); periods is the one row (m).

    Draws follow each other, modulo m, and begin anew with a chance of 1 in ``mean_block``, so that blocks have geometric
    lengths.  Chances are digits of MD5 digests of (rep, place), the same in every run and on any engine.  A replicate is one
    series of m periods, ordered in one task."""
    places = periods.select("m", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    digest = F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col("i").cast("string")).cast("binary"))
    number = lambda at: F.conv(F.substring("digest", at, 8), 16, 10).cast("long")
    fresh = (F.col("i") == 0) | (number(9) % mean_block == 0)
    begun = places.withColumn("digest", digest).withColumn("from", F.when(fresh, F.struct("i", (number(1) % F.col("m")).alias("start"))))
    last = F.last("from", ignorenulls=True).over(Window.partitionBy("rep").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    block = (F.col("last.start") + F.col("i") - F.col("last.i")) % F.col("m")
    return begun.withColumn("last", last).groupBy("rep", block.alias("block")).agg(F.count("*").alias("times"))


def stationary_means(blocks: DataFrame, replicates: int, mean_block: int, key: str) -> DataFrame:
    """(key, rep, mean) of blocks(key, block, s, n): means of the rows of the periods drawn, the same draws for each key.

    block is 0, 1, ..., of which the last one is the same for all keys; a key may lack some."""
    periods = blocks.agg((F.max("block") + 1).alias("m")).where("m IS NOT NULL")  # one row
    drawn = stationary_draws(periods, replicates, mean_block).join(blocks, "block")
    return drawn.groupBy(key, "rep").agg((F.sum(F.col("times") * F.col("s")) / F.sum(F.col("times") * F.col("n"))).alias("mean"))


def bootstrap_interval(blocks: DataFrame, replicates: int, mean_block: int, key: str, percent: int = 95) -> DataFrame:
    """(key, mean, lower, upper): the mean of each key's rows, and the percentile interval of its bootstrap means that is to
    hold the true one so often; replicates without a row of the key don't count."""
    tail = (100 - percent) / 200
    own = blocks.groupBy(key).agg((F.sum("s") / F.sum("n")).alias("mean"))
    ends = stationary_means(blocks, replicates, mean_block, key).groupBy(key).agg(F.percentile("mean", F.lit(tail)).alias("lower"), F.percentile("mean", F.lit(1 - tail)).alias("upper"))
    return own.join(ends, key)


def superior_ability(blocks: DataFrame, replicates: int, mean_block: int, key: str) -> DataFrame:
    """(strategies, periods, statistic, p_lower, p_consistent, p_upper): the test for superior predictive ability of Hansen
    (2005), of blocks(key, block, x) with the gain of each strategy over its benchmark in each period, 0 where absent.

    Mean gains are divided by their deviations over the bootstrap.  Under the null, replicates are centred at all gains
    (upper), at those that aren't far below nothing (consistent), or at positive ones (lower); a p-value is the share of
    replicates whose best strategy beats the one observed.  Strategies without deviation are left out."""
    periods = blocks.agg((F.max("block") + 1).alias("m")).where("m IS NOT NULL")  # one row
    m = F.col("m")
    own = blocks.groupBy(key).agg(F.sum("x").alias("total")).join(F.broadcast(periods)).withColumn("gain", F.col("total") / m)
    drawn = stationary_draws(periods, replicates, mean_block).join(blocks, "block").groupBy(key, "rep").agg(F.sum(F.col("times") * F.col("x")).alias("drawn"))
    every = own.join(F.broadcast(periods.select(F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")))).join(drawn, [key, "rep"], "left")  # replicates are few
    every = every.withColumn("again", F.coalesce("drawn", F.lit(0.0)) / m)
    spread = every.groupBy(key, "gain", "m").agg(F.sqrt(m * F.avg(F.pow(F.col("again") - F.col("gain"), F.lit(2.0)))).alias("omega")).where("omega > 1e-12")
    far = -F.col("omega") / F.sqrt(m) * F.sqrt(2 * F.log(F.log(m.cast("double"))))
    centres = {"lower": F.greatest("gain", F.lit(0.0)), "consistent": F.when(F.col("gain") >= F.when(m > 2, far).otherwise(0.0), F.col("gain")).otherwise(0.0), "upper": F.col("gain")}
    root = F.sqrt(m)
    best = every.join(spread.select(key, "omega"), key).groupBy("rep").agg(*(F.greatest(F.lit(0.0), F.max(root * (F.col("again") - centre) / F.col("omega"))).alias(name) for name, centre in centres.items()))
    seen = spread.agg(F.count("*").alias("strategies"), F.max("m").alias("periods"), F.greatest(F.lit(0.0), F.max(root * F.col("gain") / F.col("omega"))).alias("statistic"))  # one row
    share = lambda name: F.avg(F.when(F.round(name, 9) > F.round("statistic", 9), 1.0).otherwise(0.0)).alias(f"p_{name}")
    return best.join(F.broadcast(seen)).groupBy("strategies", "periods", "statistic").agg(*(share(name) for name in centres))


def tail_probability(z):
    """Two-sided normal tail by a logistic approximation, as any SQL engine can compute it; within 0.0003."""
    return F.lit(2.0) / (1 + F.exp(F.lit(1.5976) * F.abs(z) + F.lit(0.07056) * F.pow(F.abs(z), F.lit(3.0))))


def benjamini_yekutieli(tests: DataFrame, p: str, tie: list[str]) -> DataFrame:
    """tests with ``adjusted``, the least level at which each is rejected under any dependence; few rows."""
    up = Window.orderBy(p, *tie)
    out = tests.withColumn("_k", F.row_number().over(up)).withColumn("_m", F.count("*").over(Window.partitionBy()))
    out = out.withColumn("_c", F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("_m")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i))
    out = out.withColumn("_q", F.col(p) * F.col("_m") * F.col("_c") / F.col("_k"))
    down = Window.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("adjusted", F.round(F.least(F.lit(1.0), F.min("_q").over(down)), 9)).drop("_k", "_m", "_c", "_q")
