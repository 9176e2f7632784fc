"""Registered queries of the time-series engine, with their SQL for another engine.

Bars are hourly bars of the events table, with the event type as symbol and the value as price; slot is the
hour since 1970.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators import evaluation, labels, pointintime, profile, stats, waves
from tidemark.operators.series import windowed
from tidemark.plans.tables import read, settle
from tidemark.sources.bars import event_bars, order_bars, slot

QUERIES: dict = {}
SQL: dict[str, str] = {}

_BARS = """bars AS (SELECT *, epoch(t)::BIGINT // 3600 AS slot FROM (
  SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS t, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, round(sum(value), 6) AS volume, count(*) AS n FROM events GROUP BY ALL))"""
_DIRTY = _BARS + """, dirty AS (SELECT symbol, t, slot, CASE WHEN slot % 23 = 0 THEN NULL ELSE open END AS open, CASE WHEN slot % 17 = 0 THEN low - 1 ELSE high END AS high,
  CASE WHEN slot % 19 = 0 THEN -low ELSE low END AS low, close, CASE WHEN slot % 11 < 3 THEN 0 ELSE volume END AS volume FROM bars)"""


def query(name: str, sql: str | None = None):
    def add(make):
        QUERIES[name] = make
        if sql:
            SQL[name] = sql
        return make

    return add


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(read(spark, sf_dir, "events")).withColumn("slot", slot("t"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with planted faults: every 17th high below its low, every 19th low negative, every 23rd open NaN."""
    s = F.col("slot")
    return bars(spark, sf_dir).select("symbol", "t", "slot", F.when(s % 23 == 0, float("nan")).otherwise(F.col("open")).alias("open"), F.when(s % 17 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"), F.when(s % 19 == 0, -F.col("low")).otherwise(F.col("low")).alias("low"), "close", F.when(s % 11 < 3, 0.0).otherwise(F.col("volume")).alias("volume"))


@query("bars_ohlcv", f"WITH {_BARS} SELECT symbol, t, open, high, low, close, volume, n FROM bars")
def bars_ohlcv(spark, sf_dir):
    return bars(spark, sf_dir).drop("slot")


@query("bars_daily_orders", """SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS t, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, round(sum(o_totalprice), 2) AS volume, count(*) AS n FROM orders GROUP BY ALL""")
def bars_daily_orders(spark, sf_dir):
    return order_bars(read(spark, sf_dir, "orders")).withColumn("volume", F.round("volume", 2))


@query("bar_quality", f"""WITH {_DIRTY}, d AS (SELECT *, slot - lag(slot) OVER (PARTITION BY symbol ORDER BY slot) AS diff FROM dirty)
SELECT symbol, count(*) AS rows, count(*) - count(DISTINCT slot) AS duplicates, count(*) FILTER (diff <= 0) AS non_monotonic, count(*) FILTER (diff > 1) AS gaps, coalesce(sum(diff - 1) FILTER (diff > 1), 0)::BIGINT AS missing,
  count(*) FILTER (high < greatest(open, close) OR low > least(open, close) OR high < low) AS ohlc_violations,
  sum((coalesce(open < 0, false))::BIGINT + (high < 0)::BIGINT + (low < 0)::BIGINT + (close < 0)::BIGINT + (volume < 0)::BIGINT)::BIGINT AS negative_values,
  count(*) FILTER (volume = 0) AS zero_volume, min(close) AS min_close, max(close) AS max_close FROM d GROUP BY symbol""")
def bar_quality(spark, sf_dir):
    return profile.bar_quality(dirty(spark, sf_dir))


@query("coverage_summary", f"""WITH {_BARS}, span AS (SELECT min(slot) AS lo, max(slot) AS hi FROM bars)
SELECT symbol, min(slot) AS first_slot, max(slot) AS last_slot, count(DISTINCT slot) AS present, any_value(hi - lo + 1) AS expected, any_value(hi - lo + 1) - count(DISTINCT slot) AS missing FROM bars, span GROUP BY symbol""")
def coverage_summary(spark, sf_dir):
    return profile.coverage(bars(spark, sf_dir))


_MISSING = f"""WITH {_BARS}, cal AS (SELECT symbol, unnest(generate_series(lo, hi)) AS slot FROM (SELECT DISTINCT symbol FROM bars), (SELECT min(slot) AS lo, max(slot) AS hi FROM bars)),
missing AS (SELECT symbol, slot FROM cal ANTI JOIN bars USING (symbol, slot)) """


@query("coverage_missing", _MISSING + "SELECT symbol, slot FROM missing")
def coverage_missing(spark, sf_dir):
    return profile.missing_slots(bars(spark, sf_dir))


@query("coverage_missing_first10", _MISSING + "SELECT symbol, slot FROM missing ORDER BY symbol, slot LIMIT 10")
def coverage_missing_first10(spark, sf_dir):
    return profile.missing_slots(bars(spark, sf_dir)).orderBy("symbol", "slot").limit(10)


_KEYS = """objects AS (SELECT symbol || CASE WHEN d % 5 = 0 THEN '-1m-' || strftime(day, '%Y-%m') ELSE '-1m-' || strftime(day, '%Y-%m-%d') END || CASE WHEN d % 7 = 0 THEN '.csv' ELSE '.zip' END AS key
  FROM (SELECT DISTINCT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS day, day(ts) AS d FROM events)), dated AS (SELECT key, regexp_extract(key, '([0-9]{4}-[0-9]{2}(-[0-9]{2})?)[.]zip$', 1) AS date FROM objects) """


def objects(spark, sf_dir):
    """Names of archived objects, one a symbol and day; some of months, some that are no archives."""
    days = read(spark, sf_dir, "events").select("event_type", F.date_trunc("day", "ts").alias("day")).distinct()
    d = F.dayofmonth("day")
    name = F.concat("event_type", F.lit("-1m-"), F.when(d % 5 == 0, F.date_format("day", "yyyy-MM")).otherwise(F.date_format("day", "yyyy-MM-dd")), F.when(d % 7 == 0, ".csv").otherwise(".zip"))
    return days.select(name.alias("key")).withColumn("date", keys.date_of(F.col("key")))


@query("key_dates", f"WITH {_KEYS} SELECT key, date FROM dated")
def key_dates(spark, sf_dir):
    return objects(spark, sf_dir)


@query("prefix_window", f"""WITH {_KEYS} SELECT date, count(*) AS objects, count(*) FILTER (substr('2024-01-10', 1, length(date)) <= date AND date <= substr('2024-01-20', 1, length(date))) AS in_window FROM dated GROUP BY date""")
def prefix_window(spark, sf_dir):
    return objects(spark, sf_dir).groupBy("date").agg(F.count("*").alias("objects"), F.count_if(keys.in_window(F.col("date"), "2024-01-10", "2024-01-20")).alias("in_window"))


@query("ohlc_violations", f"WITH {_DIRTY} SELECT symbol, slot FROM dirty WHERE high < greatest(open, close) OR low > least(open, close) OR high < low")
def ohlc_violations(spark, sf_dir):
    return dirty(spark, sf_dir).where(keys.ohlc_violation(*(F.col(c) for c in ("open", "high", "low", "close")))).select("symbol", "slot")


@query("negative_cells", f"WITH {_DIRTY} SELECT symbol, slot, (coalesce(open < 0, false))::BIGINT + (high < 0)::BIGINT + (low < 0)::BIGINT + (close < 0)::BIGINT + (volume < 0)::BIGINT AS cells FROM dirty WHERE least(open, high, low, close, volume) < 0")
def negative_cells(spark, sf_dir):
    return dirty(spark, sf_dir).select("symbol", "slot", keys.negative_cells(*(F.col(c) for c in ("open", "high", "low", "close", "volume"))).alias("cells")).where("cells > 0")


@query("zero_volume", f"WITH {_DIRTY} SELECT symbol, count(*) AS zero FROM dirty WHERE volume = 0 GROUP BY symbol")
def zero_volume(spark, sf_dir):
    return dirty(spark, sf_dir).where("volume = 0").groupBy("symbol").agg(F.count("*").alias("zero"))


@query("dup_and_mode", f"""WITH {_BARS}, c AS (SELECT symbol, n, count(*) AS k FROM bars GROUP BY ALL)
SELECT symbol, min(n) AS mode_n, (SELECT count(*) - count(DISTINCT t) FROM bars b WHERE b.symbol = x.symbol) AS duplicates FROM (SELECT symbol, n, k, max(k) OVER (PARTITION BY symbol) AS top FROM c) x WHERE k = top GROUP BY symbol""")
def dup_and_mode(spark, sf_dir):
    return bars(spark, sf_dir).groupBy("symbol").agg(F.mode("n", True).alias("mode_n"), (F.count("*") - F.count_distinct("t")).alias("duplicates"))


_STEPS = f"WITH {_BARS}, d AS (SELECT *, slot - lag(slot) OVER (PARTITION BY symbol ORDER BY slot) AS diff FROM bars) "


@query("gap_profile", _STEPS + "SELECT symbol, count(*) FILTER (diff > 1) AS gaps, coalesce(sum(diff - 1) FILTER (diff > 1), 0)::BIGINT AS missing FROM d GROUP BY symbol")
def gap_profile(spark, sf_dir):
    return profile.steps(bars(spark, sf_dir)).groupBy("symbol").agg(F.count_if(F.col("diff") > 1).alias("gaps"), F.coalesce(F.sum(F.when(F.col("diff") > 1, F.col("diff") - 1)), F.lit(0)).alias("missing"))


@query("topk_gaps", _STEPS + "SELECT symbol, slot AS resumes, diff - 1 AS gap, row_number() OVER (PARTITION BY symbol ORDER BY diff DESC, slot) AS place FROM d WHERE diff > 1 QUALIFY place <= 3")
def topk_gaps(spark, sf_dir):
    return profile.largest_gaps(bars(spark, sf_dir), 3)


_RUNS = """SELECT symbol, min(slot) AS start_slot, max(slot) AS end_slot, count(*) AS length FROM (SELECT symbol, slot, slot - row_number() OVER (PARTITION BY symbol ORDER BY slot) AS island FROM {0}) GROUP BY symbol, island"""


@query("runs", f"WITH {_BARS} " + _RUNS.format("bars"))
def runs(spark, sf_dir):
    return profile.runs(bars(spark, sf_dir))


@query("filler_runs", f"WITH {_DIRTY} " + _RUNS.format("dirty WHERE volume = 0"))
def filler_runs(spark, sf_dir):
    return profile.runs(dirty(spark, sf_dir).where("volume = 0"))


@query("grid_alignment", "SELECT event_type AS symbol, count(*) FILTER (epoch(ts)::BIGINT % 300 <> 0) AS off_grid, count(*) AS rows FROM (SELECT event_type, date_trunc('second', ts)::TIMESTAMP AS ts FROM events) GROUP BY event_type")
def grid_alignment(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.count_if(F.pmod(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(300)) != 0).alias("off_grid"), F.count("*").alias("rows"))


@query("nan_census", f"WITH {_DIRTY} SELECT symbol, count(*) FILTER (open IS NULL) AS open, count(*) FILTER (high IS NULL) AS high, count(*) FILTER (low IS NULL) AS low, count(*) FILTER (close IS NULL) AS close FROM dirty GROUP BY symbol")
def nan_census(spark, sf_dir):
    return dirty(spark, sf_dir).groupBy("symbol").agg(*(F.count_if(F.isnan(c) | F.col(c).isNull()).alias(c) for c in ("open", "high", "low", "close")))


@query("interval_semi", f"WITH {_DIRTY}, r AS ({_RUNS.format('dirty WHERE volume = 0')}) SELECT symbol, slot FROM bars b WHERE n > 2 AND EXISTS (SELECT 1 FROM r WHERE r.symbol = b.symbol AND b.slot BETWEEN start_slot AND end_slot)")
def interval_semi(spark, sf_dir):
    found = profile.runs(dirty(spark, sf_dir).where("volume = 0"))
    days = found.select("symbol", "start_slot", "end_slot", F.explode(F.sequence(F.floor(F.col("start_slot") / 24), F.floor(F.col("end_slot") / 24))).alias("day"))
    points = bars(spark, sf_dir).where("n > 2").select("symbol", "slot", F.floor(F.col("slot") / 24).alias("day"))
    on = (points["symbol"] == days["symbol"]) & (points["day"] == days["day"]) & points["slot"].between(days["start_slot"], days["end_slot"])
    return points.join(days, on, "left_semi").select("symbol", "slot")


@query("cross_symbol_coincidence", f"WITH {_DIRTY} SELECT slot, count(DISTINCT symbol) AS symbols FROM dirty WHERE volume = 0 GROUP BY slot HAVING count(DISTINCT symbol) = 5")
def cross_symbol_coincidence(spark, sf_dir):
    return dirty(spark, sf_dir).where("volume = 0").groupBy("slot").agg(F.count_distinct("symbol").alias("symbols")).where("symbols = 5")


@query("tier_reconciliation", f"WITH {_DIRTY} SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.slot, b.slot) AS slot, a.high AS monthly, b.high AS daily FROM (SELECT * FROM bars WHERE slot % 29 <> 0) a FULL OUTER JOIN (SELECT * FROM dirty WHERE slot % 31 <> 0) b ON a.symbol = b.symbol AND a.slot = b.slot WHERE a.high IS DISTINCT FROM b.high")
def tier_reconciliation(spark, sf_dir):
    one = bars(spark, sf_dir).where("slot % 29 <> 0").select("symbol", "slot", F.col("high").alias("monthly"))
    two = dirty(spark, sf_dir).where("slot % 31 <> 0").select("symbol", "slot", F.col("high").alias("daily"))
    return one.join(two, ["symbol", "slot"], "full_outer").where(~F.col("monthly").eqNullSafe(F.col("daily")))


@query("manifest_resume", f"WITH {_KEYS} SELECT key FROM dated WHERE key NOT IN (SELECT key FROM dated WHERE date LIKE '2024-01-1%')")
def manifest_resume(spark, sf_dir):
    every = objects(spark, sf_dir)
    return every.join(every.where("date LIKE '2024-01-1%'").select("key"), "key", "left_anti").select("key")


@query("version_hash", f"WITH {_KEYS} SELECT date, sha256(string_agg(key || ':' || sha256(key), chr(10) ORDER BY key)) AS version FROM dated GROUP BY date")
def version_hash(spark, sf_dir):
    line = F.concat("key", F.lit(":"), F.sha2("key", 256))
    return objects(spark, sf_dir).groupBy("date").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", line.alias("line")))), lambda x: x["line"]), "\n"), 256).alias("version"))


@query("rolling_sigma", f"WITH {_BARS} SELECT symbol, slot, round(stddev_samp(close) OVER (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 9) AS sigma FROM bars")
def rolling_sigma(spark, sf_dir):
    return pointintime.sigma(bars(spark, sf_dir), 24).select("symbol", "slot", "sigma")


_BREAKOUT = f"""{_BARS}, b AS (SELECT *, max(high) OVER w AS prev_high, min(low) OVER w AS prev_low FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
signals AS (SELECT *, CASE WHEN close > prev_high THEN 1 WHEN close < prev_low THEN -1 ELSE 0 END AS signal FROM b)"""


@query("breakout", f"WITH {_BREAKOUT} SELECT symbol, slot, prev_high, prev_low, signal FROM signals")
def breakout(spark, sf_dir):
    return pointintime.breakout(bars(spark, sf_dir), 12).select("symbol", "slot", "prev_high", "prev_low", "signal")


@query("filler_taint", f"WITH {_DIRTY} SELECT symbol, slot, bool_or(volume = 0) OVER (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS tainted FROM dirty")
def filler_taint(spark, sf_dir):
    return pointintime.tainted(dirty(spark, sf_dir).withColumn("filler", F.col("volume") == 0), "filler", 3).select("symbol", "slot", "tainted")


@query("regime_transition", f"WITH {_BREAKOUT}, r AS (SELECT *, lag(signal) OVER (PARTITION BY symbol ORDER BY slot) AS before FROM signals) SELECT symbol, slot, before, signal FROM r WHERE before <> signal")
def regime_transition(spark, sf_dir):
    return pointintime.transitions(pointintime.breakout(bars(spark, sf_dir), 12), "signal").select("symbol", "slot", "before", "signal")


_METRICS = "metrics AS (SELECT symbol, t + INTERVAL 65 MINUTE AS t, volume AS metric FROM bars WHERE slot % 3 = 0)"


def metrics(spark, sf_dir):
    """A slower series that is known five minutes after its hour ends."""
    return bars(spark, sf_dir).where("slot % 3 = 0").select("symbol", (F.col("t") + F.expr("INTERVAL 65 MINUTES")).alias("t"), F.col("volume").alias("metric"))


@query("asof_metrics", f"WITH {_BARS}, {_METRICS} SELECT b.symbol, b.t, b.slot, metric FROM bars b ASOF LEFT JOIN metrics m ON b.symbol = m.symbol AND b.t >= m.t")
def asof_metrics(spark, sf_dir):
    return pointintime.as_of(bars(spark, sf_dir).select("symbol", "t", "slot"), metrics(spark, sf_dir), "metric", "metric")


_FUNDING = "funding AS (SELECT symbol, t, close AS rate FROM bars WHERE slot % 8 = 0)"


@query("asof_funding", f"WITH {_BARS}, {_FUNDING} SELECT b.symbol, b.t, b.slot, rate FROM bars b ASOF LEFT JOIN funding f ON b.symbol = f.symbol AND b.t > f.t")
def asof_funding(spark, sf_dir):
    every = bars(spark, sf_dir)
    return pointintime.as_of(every.select("symbol", "t", "slot"), every.where("slot % 8 = 0").select("symbol", "t", F.col("close").alias("rate")), "rate", "rate", strict=True)


@query("feature_table", f"""WITH {_BARS} SELECT symbol, slot, round(close / lag(close, 6) OVER w - 1, 9) AS momentum_6, round(avg(close) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 9) AS mean_12,
  max(high) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) - min(low) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS range_12, round(volume / sum(volume) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 9) AS volume_share_24 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY slot)""")
def feature_table(spark, sf_dir):
    return pointintime.features(bars(spark, sf_dir)).select("symbol", "slot", *pointintime.FEATURES)


@query("truncation_check", f"WITH {_BARS}, m AS (SELECT (min(slot) + max(slot)) // 2 AS m FROM bars) SELECT symbol, max(slot) FILTER (slot <= m) AS slot FROM bars, m GROUP BY symbol HAVING max(slot) > any_value(m) AND min(slot) <= any_value(m)")
def truncation_check(spark, sf_dir):
    """Rows of the earlier half that change once the later one is known: each symbol's last, as one feature looks a bar ahead."""
    every = bars(spark, sf_dir)
    middle = every.agg(F.floor((F.min("slot") + F.max("slot")) / 2).alias("m")).first()["m"]
    return pointintime.truncation_failures(every, middle, {**pointintime.FEATURES, "next_close": (1, lambda w: F.lead("close").over(w))})


THETAS = [0.3, 0.6, 0.9]
_CHANGES = f"""{_BARS}, s AS (SELECT symbol, theta, slot, close, row_number() OVER (PARTITION BY symbol, theta ORDER BY slot) AS i FROM bars, (VALUES (0.3::DOUBLE), (0.6::DOUBLE), (0.9::DOUBLE)) v(theta)),
fold AS (
  SELECT symbol, theta, i, slot, close, 0 AS dir, close AS hi, slot AS hi_at, close AS lo, slot AS lo_at, 0 AS ev, 0::BIGINT AS ev_at, 0::DOUBLE AS ev_px FROM s WHERE i = 1
  UNION ALL
  SELECT symbol, theta, i, slot, close,
    CASE WHEN up_ev THEN 1 WHEN dn_ev THEN -1 ELSE dir END, CASE WHEN up_ev OR dn_ev THEN close ELSE nhi END, CASE WHEN up_ev OR dn_ev THEN slot ELSE nhi_at END, CASE WHEN up_ev OR dn_ev THEN close ELSE nlo END, CASE WHEN up_ev OR dn_ev THEN slot ELSE nlo_at END,
    CASE WHEN up_ev THEN 1 WHEN dn_ev THEN -1 ELSE 0 END, CASE WHEN up_ev THEN nlo_at ELSE nhi_at END, CASE WHEN up_ev THEN nlo ELSE nhi END
  FROM (SELECT *, dir <= 0 AND close >= nlo * (1 + theta) AS up_ev, (dir = 1 OR dir = 0 AND NOT close >= nlo * (1 + theta)) AND close <= nhi * (1 - theta) AS dn_ev FROM (
    SELECT s.symbol, s.theta, s.i, s.slot, s.close, f.dir, greatest(f.hi, s.close) AS nhi, CASE WHEN s.close > f.hi THEN s.slot ELSE f.hi_at END AS nhi_at, least(f.lo, s.close) AS nlo, CASE WHEN s.close < f.lo THEN s.slot ELSE f.lo_at END AS nlo_at
    FROM fold f JOIN s ON s.symbol = f.symbol AND s.theta = f.theta AND s.i = f.i + 1))
), changes AS (SELECT symbol, theta, ev AS direction, ev_at AS extreme_slot, ev_px AS extreme, slot AS confirm_slot, close AS confirm FROM fold WHERE ev <> 0)"""


def changes(spark, sf_dir, thetas=THETAS):
    return waves.directional_changes(bars(spark, sf_dir), thetas)


@query("dc_events", f"WITH RECURSIVE {_CHANGES} SELECT symbol, direction, extreme_slot, extreme, confirm_slot, confirm FROM changes WHERE theta = 0.3")
def dc_events(spark, sf_dir):
    return changes(spark, sf_dir, [0.3]).drop("theta")


@query("dc_multiscale", f"WITH RECURSIVE {_CHANGES} SELECT symbol, theta, count(*) AS changes, sum(confirm_slot - extreme_slot)::BIGINT AS lag_steps FROM changes GROUP BY ALL")
def dc_multiscale(spark, sf_dir):
    return changes(spark, sf_dir).groupBy("symbol", "theta").agg(F.count("*").alias("changes"), F.sum(F.col("confirm_slot") - F.col("extreme_slot")).alias("lag_steps"))


_SEGMENTS = f"""{_CHANGES}, seg AS (SELECT symbol, theta, direction, extreme_slot AS start_slot, lead(extreme_slot) OVER w AS end_slot, lead(extreme_slot) OVER w - extreme_slot AS bars, round(lead(extreme) OVER w / extreme - 1, 9) AS amplitude
  FROM changes WINDOW w AS (PARTITION BY symbol, theta ORDER BY confirm_slot)), segs AS (SELECT * FROM seg WHERE end_slot IS NOT NULL)"""


@query("wave_segments", f"WITH RECURSIVE {_SEGMENTS} SELECT * FROM segs")
def wave_segments(spark, sf_dir):
    return waves.segments(changes(spark, sf_dir))


@query("wave_stats", f"WITH RECURSIVE {_SEGMENTS} SELECT symbol, theta, direction, count(*) AS waves, round(avg(amplitude), 6) AS mean_amplitude, round(avg(bars), 6) AS mean_bars, max(bars) AS longest FROM segs GROUP BY ALL")
def wave_stats(spark, sf_dir):
    return waves.wave_statistics(waves.segments(changes(spark, sf_dir)))


@query("wave_times", f"WITH RECURSIVE {_CHANGES} SELECT c.symbol, theta, extreme_slot, confirm_slot, b.slot AS entry_slot, b.open AS entry FROM changes c JOIN bars b ON b.symbol = c.symbol AND b.slot = confirm_slot + 1")
def wave_times(spark, sf_dir):
    entry = bars(spark, sf_dir).select("symbol", F.col("slot").alias("entry_slot"), F.col("open").alias("entry"))
    found = changes(spark, sf_dir).withColumn("entry_slot", F.col("confirm_slot") + 1)
    return found.join(entry, ["symbol", "entry_slot"]).select("symbol", "theta", "extreme_slot", "confirm_slot", "entry_slot", "entry")


@query("pullback", f"WITH RECURSIVE {_SEGMENTS} SELECT s.symbol, s.start_slot, s.end_slot, s.direction, l.start_slot AS large_start, l.end_slot AS large_end FROM segs s JOIN segs l ON s.symbol = l.symbol AND s.direction = -l.direction AND s.start_slot >= l.start_slot AND s.end_slot <= l.end_slot WHERE s.theta = 0.3 AND l.theta = 0.9")
def pullback(spark, sf_dir):
    every = settle(waves.segments(changes(spark, sf_dir)), "segments")
    found = waves.pullbacks(every.where("theta = 0.3"), every.where("theta = 0.9"))
    return found.select("symbol", "start_slot", "end_slot", "direction", "large_start", "large_end")


@query("sideways", f"""WITH RECURSIVE {_CHANGES}, e AS (SELECT symbol, confirm_slot FROM changes WHERE theta = 0.6)
SELECT b.symbol, b.slot, b.slot - e.confirm_slot AS quiet FROM bars b ASOF JOIN e ON b.symbol = e.symbol AND b.slot >= e.confirm_slot WHERE b.slot - e.confirm_slot >= 6""")
def sideways(spark, sf_dir):
    every = bars(spark, sf_dir)
    confirmed = changes(spark, sf_dir, [0.6]).select("symbol", F.col("confirm_slot").alias("slot"), F.col("confirm_slot").alias("last"))
    events = every.select("symbol", "slot", "t").join(confirmed, ["symbol", "slot"]).select("symbol", "t", "last")
    out = pointintime.as_of(every.select("symbol", "t", "slot"), events, "last", "last")
    return out.withColumn("quiet", F.col("slot") - F.col("last")).where("quiet >= 6").select("symbol", "slot", "quiet")


_RETURNS = "returns AS (SELECT b.symbol, b.slot, b.volume, b.n, round(l.close / b.close - 1, 9) AS ret FROM bars b LEFT JOIN bars l ON l.symbol = b.symbol AND l.slot = b.slot + 4)"


def returns(spark, sf_dir):
    every = bars(spark, sf_dir)
    return every.select("symbol", "slot", "t", "volume", "n").join(labels.forward_return(every, 4), ["symbol", "slot"])


@query("forward_return", f"WITH {_BARS}, {_RETURNS} SELECT symbol, slot, ret FROM returns")
def forward_return(spark, sf_dir):
    return labels.forward_return(bars(spark, sf_dir), 4)


_BARRIERS = """barriers AS (SELECT e.symbol, e.slot, coalesce(first(CASE WHEN b.low <= e.close * (1 - 0.8) THEN -1 ELSE 1 END ORDER BY b.slot) FILTER (b.slot IS NOT NULL), 0) AS barrier, coalesce(min(b.slot), e.slot + 12) AS exit_slot
  FROM signals e LEFT JOIN bars b ON b.symbol = e.symbol AND b.slot > e.slot AND b.slot <= e.slot + 12 AND (b.low <= e.close * (1 - 0.8) OR b.high >= e.close * (1 + 0.8)) WHERE e.signal <> 0 GROUP BY e.symbol, e.slot)"""


def barriers(spark, sf_dir):
    every = bars(spark, sf_dir)
    return labels.triple_barrier(pointintime.breakout(every, 12).where("signal <> 0"), every, 0.8, 0.8, 12)


@query("triple_barrier", f"WITH {_BREAKOUT}, {_BARRIERS} SELECT symbol, slot, barrier, exit_slot FROM barriers")
def triple_barrier(spark, sf_dir):
    return barriers(spark, sf_dir)


@query("decile_table", f"WITH {_BARS}, {_RETURNS}, d AS (SELECT *, ntile(10) OVER (ORDER BY volume, symbol, slot) AS decile FROM returns WHERE ret IS NOT NULL) SELECT decile, count(*) AS rows, round(avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS share, round(avg(ret), 6) AS mean FROM d GROUP BY decile")
def decile_table(spark, sf_dir):
    tiled = stats.ntiles(returns(spark, sf_dir).where("ret IS NOT NULL"), "volume", ["symbol", "slot"], 10, "decile")
    return tiled.groupBy("decile").agg(F.count("*").alias("rows"), F.round(F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)), 9).alias("share"), F.round(F.avg("ret"), 6).alias("mean"))


@query("spearman_ic", f"""WITH {_BARS}, {_RETURNS}, r AS (SELECT rank() OVER (ORDER BY volume) + (count(*) OVER (PARTITION BY volume) - 1) / 2.0 AS a, rank() OVER (ORDER BY ret) + (count(*) OVER (PARTITION BY ret) - 1) / 2.0 AS b FROM returns WHERE ret IS NOT NULL)
SELECT count(*) AS n, round(corr(a, b), 9) AS ic FROM r""")
def spearman_ic(spark, sf_dir):
    return stats.rank_correlation(settle(returns(spark, sf_dir).where("ret IS NOT NULL"), "returns"), "volume", "ret", ["symbol", "slot"])


@query("two_way_table", f"WITH {_BARS}, {_RETURNS} SELECT symbol, busy, count(*) AS rows, round(avg(ret), 6) AS mean FROM (SELECT *, least(n, 5)::VARCHAR AS busy FROM returns WHERE ret IS NOT NULL) GROUP BY CUBE (symbol, busy)")
def two_way_table(spark, sf_dir):
    rows = returns(spark, sf_dir).where("ret IS NOT NULL").withColumn("busy", F.least("n", F.lit(5).cast("long")).cast("string"))
    return rows.cube("symbol", "busy").agg(F.count("*").alias("rows"), F.round(F.avg("ret"), 6).alias("mean"))


@query("block_bootstrap", f"""WITH {_BARS}, {_RETURNS}, blocks AS (SELECT slot // 24 - min(slot // 24) OVER () AS block, s, n FROM (SELECT slot // 24 * 24 AS slot, sum(ret) AS s, count(*) AS n FROM returns WHERE ret IS NOT NULL GROUP BY ALL)),
m AS (SELECT count(*) AS m FROM blocks), d AS (SELECT rep, (1103515245::BIGINT * rep + 12345::BIGINT * i * i + 6700417::BIGINT * (rep + 1) * i + 97) % 2147483647 % m AS block FROM m, range(50) r(rep), LATERAL (SELECT unnest(range(m)) AS i) x)
SELECT rep::INTEGER AS rep, round(sum(s) / sum(n), 6) AS mean FROM d JOIN blocks USING (block) GROUP BY rep""")
def block_bootstrap(spark, sf_dir):
    day = F.floor(F.col("slot") / 24)
    sums = settle(returns(spark, sf_dir).where("ret IS NOT NULL").groupBy(day.alias("day")).agg(F.sum("ret").alias("s"), F.count("*").alias("n")), "blocks")
    first = sums.agg(F.min("day").alias("first"))
    return stats.block_bootstrap(sums.join(F.broadcast(first)).select((F.col("day") - F.col("first")).alias("block"), "s", "n"), 50).withColumn("mean", F.round("mean", 6))


@query("event_clusters", f"""WITH {_BREAKOUT}, {_BARRIERS}, c AS (SELECT *, CASE WHEN slot <= max(exit_slot) OVER (PARTITION BY symbol ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM barriers),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY slot) AS cluster FROM c) SELECT symbol, min(slot) AS start_slot, max(exit_slot) AS end_slot, count(*) AS events FROM g GROUP BY symbol, cluster""")
def event_clusters(spark, sf_dir):
    rows = barriers(spark, sf_dir).withColumn("t", F.timestamp_seconds(F.col("slot") * 3600).cast("timestamp_ntz")).withColumnRenamed("exit_slot", "end_slot")
    return stats.merged_intervals(settle(rows.select("symbol", "t", "slot", "end_slot"), "intervals"))


_TESTS = f"""{_BARS}, {_RETURNS}, tests AS (SELECT symbol, (slot % 24)::BIGINT AS hour, count(*) AS n, round(avg(ret) / stddev_samp(ret) * sqrt(count(*)), 6) AS z FROM returns WHERE ret IS NOT NULL GROUP BY ALL HAVING count(*) > 2),
p AS (SELECT *, 2.0 / (1 + exp(1.5976 * abs(z) + 0.07056 * pow(abs(z), 3.0))) AS p FROM tests)"""


@query("by_fdr", f"""WITH {_TESTS}, k AS (SELECT *, row_number() OVER (ORDER BY p, symbol, hour) AS k, count(*) OVER () AS m FROM p), q AS (SELECT *, p * m * list_sum([1.0::DOUBLE / i FOR i IN range(1, m + 1)]) / k AS q FROM k)
SELECT symbol, hour, n, z, round(p, 9) AS p, round(least(1.0, min(q) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS adjusted FROM q""")
def by_fdr(spark, sf_dir):
    rows = returns(spark, sf_dir).where("ret IS NOT NULL").groupBy("symbol", (F.col("slot") % 24).alias("hour"))
    tests = rows.agg(F.count("*").alias("n"), F.round(F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.count("*")), 6).alias("z")).where("n > 2").withColumn("p", stats.tail_probability(F.col("z")))
    return stats.benjamini_yekutieli(tests, "p", ["symbol", "hour"]).withColumn("p", F.round("p", 9)).withColumn("adjusted", F.round("adjusted", 6))


_SPLIT = "CASE WHEN ({0} - lo) * 10 < (hi - lo + 1) * 6 THEN 'train' WHEN ({0} - lo) * 10 < (hi - lo + 1) * 8 THEN 'validation' ELSE 'test' END"


@query("split_counts", f"WITH {_BARS}, span AS (SELECT min(slot) AS lo, max(slot) AS hi FROM bars) SELECT symbol, {_SPLIT.format('slot')} AS split, count(*) AS rows FROM bars, span GROUP BY ALL")
def split_counts(spark, sf_dir):
    return evaluation.with_split(bars(spark, sf_dir)).groupBy("symbol", "split").agg(F.count("*").alias("rows"))


@query("embargo", f"WITH {_BARS}, span AS (SELECT min(slot) AS lo, max(slot) AS hi FROM bars) SELECT {_SPLIT.format('slot')} AS split, count(*) AS rows, max(slot) AS last_slot FROM bars, span WHERE {_SPLIT.format('slot')} = {_SPLIT.format('(slot + 24)')} GROUP BY ALL")
def embargo(spark, sf_dir):
    return evaluation.embargoed(bars(spark, sf_dir), 24).groupBy("split").agg(F.count("*").alias("rows"), F.max("slot").alias("last_slot"))


@query("walk_forward", f"""WITH {_BARS}, f AS (SELECT fold::INTEGER AS fold, lo + 240 + fold * 72 AS start, lo, slot FROM bars, (SELECT min(slot) AS lo FROM bars), range(6) r(fold))
SELECT fold, CASE WHEN slot >= start THEN 'test' ELSE 'train' END AS part, count(*) AS rows FROM f WHERE slot >= start AND slot < start + 72 OR slot + 4 < start GROUP BY ALL""")
def walk_forward(spark, sf_dir):
    every = bars(spark, sf_dir)
    return evaluation.walk_forward(every, every.agg(F.min("slot")).first()[0], 240, 72, 6, 4)


@query("purge", f"""WITH {_BREAKOUT}, {_BARRIERS}, span AS (SELECT min(slot) AS lo, max(slot) AS hi FROM barriers), s AS (SELECT *, {_SPLIT.format('slot')} AS split FROM barriers, span)
SELECT symbol, slot, exit_slot FROM s a WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM s b WHERE b.split = 'validation' AND b.symbol = a.symbol AND a.slot <= b.exit_slot AND b.slot <= a.exit_slot)""")
def purge(spark, sf_dir):
    rows = settle(evaluation.with_split(barriers(spark, sf_dir)), "labels")
    part = lambda s: rows.where(F.col("split") == s).select("symbol", "slot", "exit_slot")
    return evaluation.purged(part("train"), part("validation"))


@query("loco", f"WITH {_BARS}, {_RETURNS}, r AS (SELECT * FROM returns WHERE ret IS NOT NULL) SELECT h.symbol AS held, count(*) FILTER (r.symbol <> h.symbol) AS train_rows, round(avg(ret) FILTER (r.symbol <> h.symbol), 6) AS train_mean, round(avg(ret) FILTER (r.symbol = h.symbol), 6) AS held_mean FROM r, (SELECT DISTINCT symbol FROM bars) h GROUP BY h.symbol")
def loco(spark, sf_dir):
    # Sums a symbol first: what is joined with every held-out symbol is one row each
    sums = settle(returns(spark, sf_dir).where("ret IS NOT NULL").groupBy("symbol").agg(F.sum("ret").alias("s"), F.count("*").alias("n")), "sums")
    held = sums.select(F.col("symbol").alias("held"))
    other = F.col("symbol") != F.col("held")
    out = sums.join(F.broadcast(held)).groupBy("held").agg(F.sum(F.when(other, F.col("n"))).alias("train_rows"), (F.sum(F.when(other, F.col("s"))) / F.sum(F.when(other, F.col("n")))).alias("train_mean"), F.sum(F.when(~other, F.col("s") / F.col("n"))).alias("held_mean"))
    return out.withColumns({c: F.round(c, 6) for c in ("train_mean", "held_mean")})


def _trades(spark, sf_dir, delay: int = 0):
    every = bars(spark, sf_dir)
    return evaluation.trades(pointintime.breakout(every, 12).where("signal <> 0"), every, 4, delay)


_TRADES = "trades AS (SELECT s.symbol, s.slot, d.delay, s.signal, s.signal * (l.open / e.open - 1) AS gross FROM signals s CROSS JOIN (VALUES (0), (1)) d(delay) JOIN bars e ON e.symbol = s.symbol AND e.slot = s.slot + 1 + d.delay JOIN bars l ON l.symbol = s.symbol AND l.slot = s.slot + 5 + d.delay WHERE s.signal <> 0)"


@query("trade_pnl", f"WITH {_BREAKOUT}, {_TRADES} SELECT symbol, count(*) AS trades, round(sum(gross - 0.0012), 6) AS net, round(avg(CASE WHEN gross > 0.0012 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_rate FROM trades WHERE delay = 0 GROUP BY symbol")
def trade_pnl(spark, sf_dir):
    profit = evaluation.net(F.col("gross"), 0.0005, 0.0001)
    return _trades(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("trades"), F.round(F.sum(profit), 6).alias("net"), F.round(F.avg(F.when(F.col("gross") > 0.0012, 1.0).otherwise(0.0)), 6).alias("hit_rate"))


@query("robustness", f"WITH {_BREAKOUT}, {_TRADES} SELECT delay, fee, slip, count(*) AS trades, round(sum(gross - 2 * (0.0005 * fee + 0.0001 * slip)), 6) AS net FROM trades, (VALUES (1, 1), (2, 1), (1, 3)) c(fee, slip) GROUP BY ALL")
def robustness(spark, sf_dir):
    both = _trades(spark, sf_dir).withColumn("delay", F.lit(0)).unionByName(_trades(spark, sf_dir, 1).withColumn("delay", F.lit(1)))
    costs = spark.createDataFrame([(1, 1), (2, 1), (1, 3)], "fee int, slip int")
    sums = both.groupBy("delay").agg(F.count("*").alias("trades"), F.sum("gross").alias("g"))
    return sums.join(F.broadcast(costs)).select("delay", "fee", "slip", "trades", F.round(F.col("g") - F.col("trades") * 2 * (0.0005 * F.col("fee") + 0.0001 * F.col("slip")), 6).alias("net"))


_QUANTILE = "(sqrt(-2 * ln({0})) - (2.515517 + 0.802853 * sqrt(-2 * ln({0})) + 0.010328 * (-2 * ln({0}))) / (1 + 1.432788 * sqrt(-2 * ln({0})) + 0.189269 * (-2 * ln({0})) + 0.001308 * pow(-2 * ln({0}), 1.5)))"


@query("deflated_sharpe", f"""WITH {_BARS}, {_RETURNS}, x AS (SELECT symbol || '-' || (slot % 24) AS strategy, ret AS r, avg(ret) OVER (PARTITION BY symbol, slot % 24) AS m FROM returns WHERE ret IS NOT NULL),
e AS (SELECT strategy, avg(r) / stddev_samp(r) AS sharpe, count(*) AS n, avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5) AS skew, avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2) AS kurt FROM x GROUP BY strategy HAVING count(*) > 2),
w AS (SELECT count(*)::DOUBLE AS trials, stddev_samp(sharpe) AS spread FROM e WHERE sharpe IS NOT NULL), l AS (SELECT trials, spread * ((1 - 0.5772156649015329) * {_QUANTILE.format('1 / trials')} + 0.5772156649015329 * {_QUANTILE.format('1 / (trials * 2.718281828459045)')}) AS lift FROM w),
z AS (SELECT strategy, sharpe, n, (sharpe - lift) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) AS z FROM e, l WHERE trials > 1 AND sharpe IS NOT NULL), t AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z),
p AS (SELECT *, exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS tail FROM t)
SELECT strategy, round(sharpe, 6) AS sharpe, n, round(CASE WHEN z >= 0 THEN 1 - tail ELSE tail END, 6) AS deflated FROM p""")
def deflated_sharpe(spark, sf_dir):
    rows = evaluation.deflated_sharpe(returns(spark, sf_dir).where("ret IS NOT NULL").select(F.concat_ws("-", "symbol", (F.col("slot") % 24).cast("string")).alias("strategy"), F.col("ret").alias("r")))
    return rows.withColumns({c: F.round(c, 6) for c in ("sharpe", "deflated")})


@query("pbo", f"""WITH {_BARS}, {_RETURNS}, b AS (SELECT symbol || '-' || (slot % 6) AS strategy, ((slot - lo) * 6 // (hi - lo + 1))::INTEGER AS block, sum(ret) AS s, count(*) AS n FROM returns, (SELECT min(slot) AS lo, max(slot) AS hi FROM returns WHERE ret IS NOT NULL) WHERE ret IS NOT NULL GROUP BY ALL),
c AS (SELECT x * 36 + y * 6 + z AS combination, unnest([x, y, z])::INTEGER AS block FROM range(6) a(x), range(6) b(y), range(6) d(z) WHERE x < y AND y < z),
e AS (SELECT k.combination, strategy, round(sum(s) FILTER (c.block IS NOT NULL) / sum(n) FILTER (c.block IS NOT NULL), 9) AS seen, round(sum(s) FILTER (c.block IS NULL) / sum(n) FILTER (c.block IS NULL), 9) AS unseen FROM b CROSS JOIN (SELECT DISTINCT combination FROM c) k LEFT JOIN c ON c.combination = k.combination AND c.block = b.block GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY combination ORDER BY unseen, strategy) AS place, count(*) OVER (PARTITION BY combination) AS "of", row_number() OVER (PARTITION BY combination ORDER BY seen DESC, strategy) AS top FROM e WHERE seen IS NOT NULL AND unseen IS NOT NULL)
SELECT combination::INTEGER AS combination, strategy AS best, place, "of" FROM p WHERE top = 1""")
def pbo(spark, sf_dir):
    out = evaluation.overfitting(strategy_blocks(spark, sf_dir, 6), 6)
    chosen = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: F.getbit("mask", i) == 1)  # three of six
    code = F.aggregate(chosen, F.lit(0), lambda a, i: a * 6 + i)
    return out.select(code.alias("combination"), "best", F.col("place").cast("int").alias("place"), "of")


def strategy_blocks(spark, sf_dir, count):
    """(strategy, block, s, n): forward returns of each symbol and hour of six, in blocks of equal time."""
    rows = settle(returns(spark, sf_dir).where("ret IS NOT NULL"), "returns")
    span = rows.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    block = F.floor((F.col("slot") - F.col("lo")) * count / (F.col("hi") - F.col("lo") + 1)).cast("int")
    return rows.join(F.broadcast(span)).groupBy(F.concat_ws("-", "symbol", (F.col("slot") % 6).cast("string")).alias("strategy"), block.alias("block")).agg(F.sum("ret").alias("s"), F.count("*").alias("n"))  # one row


@query("spa", f"""WITH {_BARS}, {_RETURNS}, d AS (SELECT symbol, slot // 24 AS day, sum(ret) AS s, count(*) AS n FROM returns WHERE ret IS NOT NULL GROUP BY ALL), x AS (SELECT min(day) AS first, max(day) - min(day) + 1 AS m FROM d),
r AS (SELECT rep::INTEGER AS rep, first + (1103515245::BIGINT * rep + 12345::BIGINT * i * i + 6700417::BIGINT * (rep + 1) * i + 97) % 2147483647 % m AS day FROM x, range(50) q(rep), LATERAL (SELECT unnest(range(m)) AS i) y),
b AS (SELECT rep, symbol, sum(s) / sum(n) AS mean FROM r JOIN d USING (day) GROUP BY ALL), o AS (SELECT symbol, sum(s) / sum(n) AS own FROM d GROUP BY symbol)
SELECT rep, round(max(mean - own), 6) AS best_excess, round(max(own), 6) AS best FROM b JOIN o USING (symbol) GROUP BY rep""")
def spa(spark, sf_dir):
    """White's reality check: per replicate, the best strategy's resampled mean above its own mean."""
    day = F.floor(F.col("slot") / 24)
    sums = settle(returns(spark, sf_dir).where("ret IS NOT NULL").groupBy("symbol", day.alias("day")).agg(F.sum("ret").alias("s"), F.count("*").alias("n")), "blocks")
    first = sums.agg(F.min("day").alias("first"), (F.max("day") - F.min("day") + 1).alias("m"))
    draws = first.select(F.explode(F.sequence(F.lit(0), F.lit(49))).alias("rep"), "first", "m").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    drawn = draws.select("rep", F.expr("first + (1103515245L * rep + 12345L * i * i + 6700417L * (rep + 1) * i + 97L) % 2147483647L % m").alias("day"))
    means = drawn.join(sums, "day").groupBy("rep", "symbol").agg((F.sum("s") / F.sum("n")).alias("mean"))
    own = sums.groupBy("symbol").agg((F.sum("s") / F.sum("n")).alias("own"))
    return means.join(own, "symbol").groupBy("rep").agg(F.round(F.max(F.col("mean") - F.col("own")), 6).alias("best_excess"), F.round(F.max("own"), 6).alias("best"))
