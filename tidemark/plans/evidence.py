"""Further registered queries: positions that exclude each other, intervals and tests from the stationary bootstrap, and
models that are fitted anew for each fold.  They are added to the catalogue's when this is imported."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation, features, labels, models, pointintime, positions, stats
from tidemark.plans.catalogue import _BARRIERS, _BARS, _BREAKOUT, _RETURNS, _TRADES, _SPLIT, _trades, bars, barriers, query, returns, strategy_blocks
from tidemark.plans.tables import settle

# Positions

_PATH = """nxt AS (SELECT a.*, b.slot AS next FROM {0} a ASOF LEFT JOIN {0} b ON a.symbol = b.symbol AND a.exit_slot <= b.slot),
path AS (SELECT * FROM nxt WHERE (symbol, slot) IN (SELECT (symbol, min(slot)) FROM nxt GROUP BY symbol) UNION ALL SELECT n.* FROM path p JOIN nxt n ON n.symbol = p.symbol AND n.slot = p.next)"""


@query("exclusive_positions", f"WITH RECURSIVE {_BREAKOUT}, {_BARRIERS}, {_PATH.format('barriers')} SELECT symbol, slot, barrier, exit_slot FROM path")
def exclusive_positions(spark, sf_dir):
    """Breakouts that one position a symbol takes in turn, each open until its barrier."""
    return positions.exclusive(barriers(spark, sf_dir))


@query("exclusive_pnl", f"""WITH RECURSIVE {_BREAKOUT}, {_TRADES}, held AS (SELECT *, slot + 4 AS exit_slot FROM trades WHERE delay = 0), {_PATH.format('held')}
SELECT symbol, count(*) AS trades, round(sum(gross - 0.0012), 6) AS net, round(avg(CASE WHEN gross > 0.0012 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_rate FROM path GROUP BY symbol""")
def exclusive_pnl(spark, sf_dir):
    """Profit of trades of four steps that don't overlap within a symbol."""
    taken = positions.exclusive(_trades(spark, sf_dir).withColumn("exit_slot", F.col("slot") + 4))
    return taken.groupBy("symbol").agg(F.count("*").alias("trades"), F.round(F.sum(F.col("gross") - 0.0012), 6).alias("net"), F.round(F.avg(F.when(F.col("gross") > 0.0012, 1.0).otherwise(0.0)), 6).alias("hit_rate"))


# Stationary bootstrap

REPLICATES, MEAN_BLOCK = 200, 3
_DRAWS = f"""g AS (SELECT r.rep, u.i, md5(r.rep || ':' || u.i) AS d, m FROM m, range({REPLICATES}) r(rep), LATERAL (SELECT unnest(range(m)) AS i) u),
h AS (SELECT *, ('0x' || d[1:8])::UBIGINT::BIGINT % m AS start, i = 0 OR ('0x' || d[9:16])::UBIGINT::BIGINT % {MEAN_BLOCK} = 0 AS fresh FROM g),
f AS (SELECT *, last_value(CASE WHEN fresh THEN start END IGNORE NULLS) OVER w AS s0, last_value(CASE WHEN fresh THEN i END IGNORE NULLS) OVER w AS i0 FROM h WINDOW w AS (PARTITION BY rep ORDER BY i ROWS UNBOUNDED PRECEDING)),
draws AS (SELECT rep, (s0 + i - i0) % m AS block, count(*) AS times FROM f GROUP BY ALL)"""


def daily(spark, sf_dir, key):
    """(key, block, s, n) of forward returns by day, block being the days since the first."""
    rows = returns(spark, sf_dir).where("ret IS NOT NULL").select(key.alias("key"), F.floor(F.col("slot") / 24).alias("day"), "ret")
    sums = settle(rows.groupBy("key", "day").agg(F.sum("ret").alias("s"), F.count("*").alias("n")), "days")
    first = sums.agg(F.min("day").alias("first"))  # one row
    return sums.join(F.broadcast(first)).select("key", (F.col("day") - F.col("first")).alias("block"), "s", "n")


@query("bootstrap_interval", f"""WITH {_BARS}, {_RETURNS}, d AS (SELECT symbol, slot // 24 - min(slot // 24) OVER () AS block, ret FROM returns WHERE ret IS NOT NULL), b AS (SELECT symbol, block, sum(ret) AS s, count(*) AS n FROM d GROUP BY ALL),
m AS (SELECT max(block) + 1 AS m FROM b), {_DRAWS}, r AS (SELECT symbol, rep, sum(times * s) / sum(times * n) AS mean FROM draws JOIN b USING (block) GROUP BY ALL)
SELECT symbol, round(o.mean, 6) AS mean, round(quantile_cont(r.mean, 0.025), 6) AS lower, round(quantile_cont(r.mean, 0.975), 6) AS upper FROM r JOIN (SELECT symbol, sum(s) / sum(n) AS mean FROM b GROUP BY symbol) o USING (symbol) GROUP BY symbol, o.mean""")
def bootstrap_interval(spark, sf_dir):
    """The mean forward return of each symbol with its 95 percent interval."""
    out = stats.bootstrap_interval(daily(spark, sf_dir, F.col("symbol")), REPLICATES, MEAN_BLOCK, "key")
    return out.select(F.col("key").alias("symbol"), *(F.round(c, 6).alias(c) for c in ("mean", "lower", "upper")))


@query("superior_ability", f"""WITH {_BARS}, {_RETURNS}, d AS (SELECT symbol || '-' || (slot % 6) AS k, slot // 24 - min(slot // 24) OVER () AS block, ret FROM returns WHERE ret IS NOT NULL), b AS (SELECT k, block, sum(ret) - 0.02 * count(*) AS x FROM d GROUP BY ALL),
m AS (SELECT max(block) + 1 AS m FROM b), {_DRAWS}, own AS (SELECT k, sum(x) / m AS gain, m FROM b, m GROUP BY k, m), t AS (SELECT k, rep, sum(times * x) AS drawn FROM draws JOIN b USING (block) GROUP BY ALL),
e AS (SELECT own.k, r.rep, gain, own.m, coalesce(drawn, 0) / own.m AS again FROM own CROSS JOIN range({REPLICATES}) r(rep) LEFT JOIN t ON t.k = own.k AND t.rep = r.rep),
s AS (SELECT k, gain, m, sqrt(m * avg(pow(again - gain, 2))) AS omega FROM e GROUP BY k, gain, m HAVING sqrt(m * avg(pow(again - gain, 2))) > 1e-12),
c AS (SELECT rep, greatest(0, max(sqrt(e.m) * (again - greatest(e.gain, 0)) / omega)) AS lower, greatest(0, max(sqrt(e.m) * (again - CASE WHEN e.gain >= CASE WHEN e.m > 2 THEN -omega / sqrt(e.m) * sqrt(2 * ln(ln(e.m::DOUBLE))) ELSE 0 END THEN e.gain ELSE 0 END) / omega)) AS consistent,
  greatest(0, max(sqrt(e.m) * (again - e.gain) / omega)) AS upper FROM e JOIN s USING (k) GROUP BY rep),
o AS (SELECT count(*) AS strategies, max(m)::BIGINT AS periods, greatest(0, max(sqrt(m) * gain / omega)) AS seen FROM s)
SELECT strategies, periods, round(seen, 6) AS statistic, count(*) FILTER (round(lower, 9) > round(seen, 9)) / count(*) AS p_lower, count(*) FILTER (round(consistent, 9) > round(seen, 9)) / count(*) AS p_consistent,
  count(*) FILTER (round(upper, 9) > round(seen, 9)) / count(*) AS p_upper FROM c, o GROUP BY strategies, periods, seen""")
def superior_ability(spark, sf_dir):
    """Whether any symbol and hour of six gains more than 0.02 a trade: Hansen's test."""
    rows = daily(spark, sf_dir, F.concat_ws("-", "symbol", (F.col("slot") % 6).cast("string")))
    out = stats.superior_ability(rows.select("key", "block", (F.col("s") - 0.02 * F.col("n")).alias("x")), REPLICATES, MEAN_BLOCK, "key")
    return out.withColumn("statistic", F.round("statistic", 6))


# Models

INPUTS, ITERATIONS, RIDGE = ["rise", "share"], 4, 1.0
_SAMPLES = f"""{_BARS}, {_RETURNS}, x AS (SELECT symbol, slot, least(greatest(round(close / lag(close, 6) OVER w - 1, 9), -1), 1) AS rise, round(volume / sum(volume) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 9) AS share FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY slot)),
samples AS (SELECT x.symbol, x.slot, rise, share, (ret > 0)::INTEGER AS up FROM x JOIN returns r USING (symbol, slot) WHERE ret IS NOT NULL AND rise IS NOT NULL AND share IS NOT NULL)"""


def _newton(iterations):
    """SQL of the same steps for a constant and two inputs; ``fit`` holds the coefficients, of the rows of ``train``."""
    out = "b0 AS (SELECT DISTINCT fold, 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2 FROM train)"
    for k in range(iterations):
        out += f""", p{k} AS (SELECT t.fold, up, rise AS x, share AS y, c0, c1, c2, 1 / (1 + exp(-(c0 + c1 * rise + c2 * share))) AS p FROM train t JOIN b{k} ON b{k}.fold = t.fold),
s{k} AS (SELECT fold, c0, c1, c2, sum(up - p) AS u, sum((up - p) * x) - {RIDGE} * c1 AS v, sum((up - p) * y) - {RIDGE} * c2 AS w, sum(p * (1 - p)) AS a, sum(p * (1 - p) * x) AS b, sum(p * (1 - p) * y) AS c,
  sum(p * (1 - p) * x * x) + {RIDGE} AS d, sum(p * (1 - p) * x * y) AS e, sum(p * (1 - p) * y * y) + {RIDGE} AS f FROM p{k} GROUP BY fold, c0, c1, c2),
b{k + 1} AS (SELECT fold, c0 + ((d * f - e * e) * u + (c * e - b * f) * v + (b * e - c * d) * w) / (a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)) AS c0,
  c1 + ((c * e - b * f) * u + (a * f - c * c) * v + (b * c - a * e) * w) / (a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)) AS c1,
  c2 + ((b * e - c * d) * u + (b * c - a * e) * v + (a * d - b * b) * w) / (a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)) AS c2 FROM s{k})"""
    return out + f", fit AS (SELECT * FROM b{iterations})"


def samples(spark, sf_dir):
    """What is known at a bar's close, and whether the close four steps on is higher."""
    every = bars(spark, sf_dir)
    known = pointintime.features(every).select("symbol", "slot", F.least(F.greatest("momentum_6", F.lit(-1.0)), F.lit(1.0)).alias("rise"), F.col("volume_share_24").alias("share"))
    rows = known.join(labels.forward_return(every, 4), ["symbol", "slot"]).where("ret IS NOT NULL AND rise IS NOT NULL AND share IS NOT NULL")
    return settle(rows.select("symbol", "slot", "rise", "share", (F.col("ret") > 0).cast("int").alias("up")), "samples")


@query("walk_forward_model", f"""WITH {_SAMPLES}, span AS (SELECT min(slot) AS lo, max(slot) AS hi FROM samples), k AS (SELECT fold::INTEGER AS fold, lo + 240 + fold * 72 AS start, s.* FROM samples s, span, LATERAL (SELECT unnest(range(greatest(0, (hi - lo + 1 - 240 + 71) // 72))) AS fold) r),
train AS (SELECT * FROM k WHERE slot + 4 + 24 < start), {_newton(ITERATIONS)}, t AS (SELECT k.*, c0, c1, c2, greatest(least(1 / (1 + exp(-(c0 + c1 * rise + c2 * share))), 1 - 1e-12), 1e-12) AS p FROM k JOIN fit USING (fold) WHERE slot >= start AND slot < start + 72)
SELECT fold, count(*) AS rows, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2, round(avg(CASE WHEN (p >= 0.5) = (up = 1) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy, round(avg(-(up * ln(p) + (1 - up) * ln(1 - p))), 6) AS log_loss FROM t GROUP BY fold, t.c0, t.c1, t.c2""")
def walk_forward_model(spark, sf_dir):
    """A logistic regression fitted anew before each test of 72 steps, on all rows before, purged and with an embargo of a day."""
    rows = samples(spark, sf_dir)
    first, last = rows.agg(F.min("slot"), F.max("slot")).first()
    folds = 0 if first is None else evaluation.fold_count(first, last, 240, 72)
    dealt = evaluation.fold_samples(rows, first or 0, 240, 72, folds, 4, 24)
    fits = dict(models.logistic(dealt.where("part = 'train'"), INPUTS, "up", ITERATIONS, RIDGE))
    tested = models.with_probability(dealt.where("part = 'test'"), fits, INPUTS)
    right = F.when((F.col("p") >= 0.5) == (F.col("up") == 1), 1.0).otherwise(0.0)
    out = tested.groupBy("fold").agg(F.count("*").alias("rows"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(models.log_loss(F.col("up"), F.col("p"))), 6).alias("log_loss"))
    table = spark.createDataFrame([(fold, *(round(x, 6) for x in beta)) for fold, beta in fits.items()], "fold int, c0 double, c1 double, c2 double")
    return out.join(F.broadcast(table), "fold")  # a row a fold


@query("model_baseline", f"""WITH {_SAMPLES}, span AS (SELECT min(slot) AS lo, max(slot) AS hi FROM samples), k AS (SELECT 0 AS fold, {_SPLIT.format('slot')} AS split, s.* FROM samples s, span WHERE {_SPLIT.format('slot')} = {_SPLIT.format('(slot + 28)')}),
train AS (SELECT * FROM k WHERE split = 'train'), {_newton(ITERATIONS)}, t AS (SELECT k.*, greatest(least(1 / (1 + exp(-(c0 + c1 * rise + c2 * share))), 1 - 1e-12), 1e-12) AS p FROM k JOIN fit USING (fold))
SELECT split, count(*) AS rows, round(avg(CASE WHEN (p >= 0.5) = (up = 1) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy, round(avg(-(up * ln(p) + (1 - up) * ln(1 - p))), 6) AS log_loss FROM t GROUP BY split""")
def model_baseline(spark, sf_dir):
    """Logistic regression of the sign of the return four hours on, by split; labels end a day before the next split."""
    rows = evaluation.embargoed(samples(spark, sf_dir), 28).withColumn("fold", F.lit(0))
    fits = dict(models.logistic(rows.where("split = 'train'"), INPUTS, "up", ITERATIONS, RIDGE))
    scored = models.with_probability(rows, fits, INPUTS)
    right = F.when((F.col("p") >= 0.5) == (F.col("up") == 1), 1.0).otherwise(0.0)
    return scored.groupBy("split").agg(F.count("*").alias("rows"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(models.log_loss(F.col("up"), F.col("p"))), 6).alias("log_loss"))


# Features

_RECURSIVE = {"ema_6": ("close", "2.0 / 7"), "ema_12": ("close", "2.0 / 13"), "ema_26": ("close", "2.0 / 27"), "atr_14": ("tr", "1.0 / 14"), "gain_14": ("gain", "1.0 / 14"), "loss_14": ("loss", "1.0 / 14")}
_FRAMED = ", ".join(
    f"""round(close / lag(close, {n}) OVER w - 1, 9) AS momentum_{n}, round(avg(close) OVER f{n}, 6) AS mean_{n}, round(stddev_samp(close) OVER f{n}, 6) AS deviation_{n}, round(max(high) OVER f{n} - min(low) OVER f{n}, 6) AS range_{n},
  round(CASE WHEN max(high) OVER f{n} > min(low) OVER f{n} THEN (close - min(low) OVER f{n}) / (max(high) OVER f{n} - min(low) OVER f{n}) END, 6) AS place_{n}, round(volume / sum(volume) OVER f{n}, 9) AS volume_share_{n},
  sum(n) OVER f{n}::BIGINT AS events_{n}, sum(CASE WHEN close > open THEN 1 ELSE 0 END) OVER f{n}::BIGINT AS rises_{n}"""
    for n in features.LENGTHS
)
_FRAMES = ", ".join(f"f{n} AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in features.LENGTHS)


_LATE = ("gain", "loss")  # inputs that a first bar lacks
_STEPS = ", ".join(f"CASE WHEN s.i = 2 THEN s.{x} ELSE r.{name} + ({a}) * (s.{x} - r.{name}) END" if x in _LATE else f"r.{name} + ({a}) * (s.{x} - r.{name})" for name, (x, a) in _RECURSIVE.items())
_ROUNDED = ", ".join(f"round(CASE WHEN r.i > 1 THEN {name} END, 6) AS {name}" if x in _LATE else f"round({name}, 6) AS {name}" for name, (x, _) in _RECURSIVE.items())
_INPUTS = """s AS (SELECT symbol, slot, close, row_number() OVER w AS i, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr,
  greatest(close - lag(close) OVER w, 0) AS gain, greatest(lag(close) OVER w - close, 0) AS loss FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY slot))"""


@query("feature_matrix", f"""WITH RECURSIVE {_BARS}, {_INPUTS}, r AS (SELECT symbol, slot, i, {', '.join(f'{x}::DOUBLE AS {name}' for name, (x, _) in _RECURSIVE.items())} FROM s WHERE i = 1
  UNION ALL SELECT s.symbol, s.slot, s.i, {_STEPS} FROM r JOIN s ON s.symbol = r.symbol AND s.i = r.i + 1), framed AS (SELECT symbol, slot, {_FRAMED} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY slot), {_FRAMES})
SELECT framed.*, slot + 1 AS known_at, {_ROUNDED} FROM framed JOIN r USING (symbol, slot)""")
def feature_matrix(spark, sf_dir):
    """38 features, six of them recursive, of every bar, with the time from which they may be used."""
    return features.feature_table(bars(spark, sf_dir))


# Overfitting


@query("pbo_16", f"""WITH {_BARS}, {_RETURNS}, b AS (SELECT symbol || '-' || (slot % 6) AS strategy, ((slot - lo) * 16 // (hi - lo + 1))::INTEGER AS block, sum(ret) AS s, count(*) AS n FROM returns, (SELECT min(slot) AS lo, max(slot) AS hi FROM returns WHERE ret IS NOT NULL) WHERE ret IS NOT NULL GROUP BY ALL),
m AS (SELECT mask FROM range(65536) r(mask) WHERE bit_count(mask) = 8),
e AS (SELECT mask, strategy, round(sum(s) FILTER ((mask >> block) & 1 = 1) / sum(n) FILTER ((mask >> block) & 1 = 1), 9) AS seen, round(sum(s) FILTER ((mask >> block) & 1 = 0) / sum(n) FILTER ((mask >> block) & 1 = 0), 9) AS unseen FROM b CROSS JOIN m GROUP BY ALL),
p AS (SELECT mask, row_number() OVER (PARTITION BY mask ORDER BY unseen, strategy) AS place, count(*) OVER (PARTITION BY mask) AS total, row_number() OVER (PARTITION BY mask ORDER BY seen DESC, strategy) AS top FROM e WHERE seen IS NOT NULL AND unseen IS NOT NULL)
SELECT total AS strategies, count(*) AS masks, round(avg(place), 2) AS mean_place, round(count(*) FILTER (place * 2 <= total) / count(*), 3) AS probability FROM p WHERE top = 1 GROUP BY total""")
def pbo_16(spark, sf_dir):
    """The probability of overfitting over all 12,870 halves of 16 blocks."""
    out = evaluation.overfitting(strategy_blocks(spark, sf_dir, 16), 16)
    return out.groupBy(F.col("of").alias("strategies")).agg(F.count("*").alias("masks"), F.round(F.avg("place"), 2).alias("mean_place"), F.round(F.avg(F.when(F.col("place") * 2 <= F.col("of"), 1.0).otherwise(0.0)), 3).alias("probability"))
