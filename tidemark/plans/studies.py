"""Further registered queries: datasets of archived objects, file profiles, sigma-scaled waves and barriers, wave
statistics, and the checks that a result has to pass.  They are added to the catalogue's when this is imported."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators import evaluation, labels, listing, pointintime, profile, stats, waves
from tidemark.operators.series import windowed
from tidemark.plans.catalogue import _BARRIERS, _BARS, _BREAKOUT, _CHANGES, _DIRTY, _RETURNS, _RUNS, _SEGMENTS, _SPLIT, _TESTS, _TRADES, _trades, bars, barriers, changes, dirty, query, returns
from tidemark.plans.tables import read, settle

# Archived objects: one for each symbol, dataset and day or month of the events table, every sixth daily one absent

_OBJECTS = """specs(dataset, kind, form) AS (VALUES ('klines_1m_monthly', '1m', 'data/futures/um/monthly/klines/%s/1m/'), ('klines_1m_daily', '1m', 'data/futures/um/daily/klines/%s/1m/'),
  ('metrics_daily', 'metrics', 'data/futures/um/daily/metrics/%s/'), ('fundingRate_monthly', 'fundingRate', 'data/futures/um/monthly/fundingRate/%s/')),
wanted AS (SELECT symbol, dataset, kind, replace(form, '%s', symbol) AS prefix FROM (SELECT DISTINCT event_type AS symbol FROM events), specs),
days AS (SELECT DISTINCT event_type AS symbol, date_trunc('day', ts)::DATE AS day FROM events),
objects AS (SELECT DISTINCT symbol, dataset, prefix || symbol || '-' || kind || '-' || CASE WHEN dataset LIKE '%_daily' THEN strftime(day, '%Y-%m-%d') ELSE strftime(day, '%Y-%m') END || '.zip' AS key
  FROM wanted JOIN days USING (symbol) WHERE NOT (dataset LIKE '%_daily' AND day(day) % 6 = 0))"""


def wanted(spark, sf_dir):
    return listing.prefixes(read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct())


def stored(spark, sf_dir):
    days = read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("date").alias("day")).distinct()
    daily = F.col("dataset").endswith("_daily")
    date = F.when(daily, F.date_format("day", "yyyy-MM-dd")).otherwise(F.date_format("day", "yyyy-MM"))
    rows = wanted(spark, sf_dir).join(days, "symbol").where(~(daily & (F.dayofmonth("day") % 6 == 0)))
    return rows.select("symbol", "dataset", listing.object_key(F.col("prefix"), F.col("symbol"), F.col("kind"), date).alias("key")).distinct()


@query("dataset_prefixes", f"WITH {_OBJECTS} SELECT symbol, dataset, kind, prefix FROM wanted")
def dataset_prefixes(spark, sf_dir):
    return wanted(spark, sf_dir)


@query("object_keys", f"WITH {_OBJECTS} SELECT symbol, dataset, key FROM objects")
def object_keys(spark, sf_dir):
    return stored(spark, sf_dir)


@query("coverage_by_dataset", f"""WITH {_OBJECTS}, d AS (SELECT *, regexp_extract(key, '([0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?)\\.zip$', 1) AS date FROM objects),
f AS (SELECT *, substr('2024-01-05', 1, length(date)) <= date AND date <= substr('2024-01-24', 1, length(date)) AS inside FROM d),
c AS (SELECT symbol, dataset, min(date) AS first_available, max(date) AS last_available, count(*) AS files_total, count(*) FILTER (inside) AS files_in_window FROM f GROUP BY ALL),
m AS (SELECT symbol, dataset, strftime(x, '%Y-%m-%d') AS day FROM wanted, unnest(generate_series(DATE '2024-01-05', DATE '2024-01-24', INTERVAL 1 DAY)) u(x) WHERE dataset LIKE '%_daily'),
n AS (SELECT symbol, dataset, count(*) AS days_missing, array_to_string((array_agg(day ORDER BY day))[1:10], ',') AS missing_sample FROM m ANTI JOIN f ON f.symbol = m.symbol AND f.dataset = m.dataset AND f.date = m.day GROUP BY ALL)
SELECT symbol, dataset, first_available, last_available, files_total, files_in_window, CASE WHEN dataset LIKE '%_daily' THEN 20::BIGINT END AS days_expected, CASE WHEN dataset LIKE '%_daily' THEN coalesce(days_missing, 0)::BIGINT END AS days_missing,
  CASE WHEN dataset LIKE '%_daily' THEN coalesce(missing_sample, '') END AS missing_sample FROM c LEFT JOIN n USING (symbol, dataset)""")
def coverage_by_dataset(spark, sf_dir):
    return listing.coverage_by_dataset(stored(spark, sf_dir), wanted(spark, sf_dir), "2024-01-05", "2024-01-24")


@query("listing_documents", f"WITH {_OBJECTS} SELECT symbol, dataset, key, max(key) OVER (PARTITION BY symbol, dataset) AS marker FROM objects")
def listing_documents(spark, sf_dir):
    """Listing documents, one a symbol and dataset and truncated, read back into the names they hold."""
    names = F.array_sort(F.collect_list("key"))  # a listing page is bounded
    entry = F.transform(names, lambda k: F.concat(F.lit("<Contents><Key>"), k, F.lit("</Key></Contents><Contents><Key>"), k, F.lit(".CHECKSUM</Key></Contents>")))
    pages = stored(spark, sf_dir).groupBy("symbol", "dataset").agg(F.concat(F.lit("<IsTruncated>true</IsTruncated>"), F.array_join(entry, "")).alias("document"))
    marked = pages.withColumn("marker", F.regexp_replace(listing.next_marker(F.col("document")), r"\.CHECKSUM$", ""))
    return listing.listed_keys(marked)


@query("latest_available", f"WITH {_OBJECTS}, d AS (SELECT dataset, regexp_extract(key, '([0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?)\\.zip$', 1) AS date FROM objects) SELECT dataset, min(date) AS first_date, max(date) AS last_date, count(*) AS files FROM d GROUP BY dataset")
def latest_available(spark, sf_dir):
    dated = stored(spark, sf_dir).withColumn("date", keys.date_of(F.col("key")))
    return dated.groupBy("dataset").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("files"))


_MANIFEST = _OBJECTS + """, manifest AS (SELECT *, sha256(key) AS sha256, CASE WHEN length(key) % 4 = 0 AND key LIKE '%-0%' THEN sha256(key || '!') WHEN key LIKE '%-17.zip' THEN NULL ELSE sha256(key) END AS expected, octet_length(encode(key)) AS bytes FROM objects)"""


def manifest(spark, sf_dir):
    bad = (F.length("key") % 4 == 0) & F.col("key").contains("-0")
    expected = F.when(bad, F.sha2(F.concat("key", F.lit("!")), 256)).when(F.col("key").endswith("-17.zip"), F.lit(None)).otherwise(F.sha2("key", 256))
    return stored(spark, sf_dir).select("*", F.sha2("key", 256).alias("sha256"), expected.alias("expected"), F.octet_length("key").cast("long").alias("bytes"))


@query("checksum_failures", f"WITH {_MANIFEST} SELECT symbol, count(*) AS files, count(*) FILTER (sha256 IS DISTINCT FROM expected) AS checksum_fail, count(*) FILTER (expected IS NULL) AS without_checksum FROM manifest GROUP BY symbol")
def checksum_failures(spark, sf_dir):
    return manifest(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("files"), F.count_if(~F.col("sha256").eqNullSafe(F.col("expected"))).alias("checksum_fail"), F.count_if(F.col("expected").isNull()).alias("without_checksum"))


@query("verified_only", f"WITH {_MANIFEST} SELECT symbol, dataset, key FROM manifest WHERE sha256 IS NOT DISTINCT FROM expected")
def verified_only(spark, sf_dir):
    return manifest(spark, sf_dir).where(F.col("sha256").eqNullSafe(F.col("expected"))).select("symbol", "dataset", "key")


@query("size_totals", f"WITH {_MANIFEST} SELECT coalesce(dataset, 'all') AS dataset, coalesce(symbol, 'all') AS symbol, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM manifest GROUP BY GROUPING SETS ((dataset, symbol), (dataset), ())")
def size_totals(spark, sf_dir):
    sums = manifest(spark, sf_dir).rollup("dataset", "symbol").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return sums.withColumns({c: F.coalesce(c, F.lit("all")) for c in ("dataset", "symbol")})


@query("file_tiers", f"""WITH {_OBJECTS}, d AS (SELECT symbol, regexp_extract(key, '([0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?)\\.zip$', 1) AS date FROM objects WHERE dataset IN ('klines_1m_monthly', 'klines_1m_daily')),
k AS (SELECT * FROM d WHERE NOT (symbol = 'click' AND length(date) = 7)) SELECT symbol, date FROM k WHERE length(date) = 7 OR NOT EXISTS (SELECT 1 FROM k m WHERE m.symbol = k.symbol AND m.date = substr(k.date, 1, 7))""")
def file_tiers(spark, sf_dir):
    """Monthly files, and daily ones of the months that a symbol has none of (clicks have none)."""
    from tidemark.sources.archive import preferred

    rows = stored(spark, sf_dir).where("dataset IN ('klines_1m_monthly', 'klines_1m_daily')").select("symbol", F.lit("klines_1m").alias("dataset"), keys.date_of(F.col("key")).alias("date"))
    return preferred(rows.where("NOT (symbol = 'click' AND length(date) = 7)")).select("symbol", "date")


@query("default_dates", """SELECT strftime(today - 10, '%Y-%m-%d') AS start, strftime(today - 1, '%Y-%m-%d') AS end, strftime(date_trunc('month', today) - INTERVAL 1 MONTH, '%Y-%m') AS month, strftime(today - 3, '%Y-%m-%d') AS sample_day
FROM (SELECT max(ts)::DATE AS today FROM events)""")
def default_dates(spark, sf_dir):
    last = read(spark, sf_dir, "events").agg(F.max("ts").cast("date").alias("today"))
    return last.select(*(c.alias(name) for name, c in listing.default_dates(F.col("today"), 10).items()))


# Files: the events of a symbol and month, in an order of their own

_FILES = """files AS (SELECT event_type AS symbol, strftime(ts, '%Y-%m') AS month, epoch_us(ts)::BIGINT // 1000 AS open_time, value, row_number() OVER (PARTITION BY event_type, strftime(ts, '%Y-%m') ORDER BY event_id % 97, event_id) - 1 AS line_no FROM events)"""


def files(spark, sf_dir):
    from tidemark.operators.series import indexed

    rows = read(spark, sf_dir, "events").select("event_type", F.date_format("ts", "yyyy-MM").alias("month"), F.unix_millis(F.col("ts").cast("timestamp")).alias("open_time"), "value", "event_id")
    order = rows.withColumn("name", F.concat_ws("/", "event_type", "month")).withColumn("at", F.col("event_id") % 97)
    return indexed(order, "name", "at", ["event_id"], F.struct("at", F.floor(F.col("event_id") / 100_000).alias("ids"))).select(F.col("event_type").alias("symbol"), "month", "open_time", "value", F.col("idx").alias("line_no"))


@query("file_profiles", f"""WITH {_FILES}, d AS (SELECT *, open_time - lag(open_time) OVER (PARTITION BY symbol, month ORDER BY line_no) AS diff FROM files)
SELECT symbol, month, count(*) AS rows, day(last_day(strptime(month || '-01', '%Y-%m-%d')))::BIGINT * 1440 AS rows_expected, CASE WHEN arg_min(open_time, line_no) > 100000000000000 THEN 'us' ELSE 'ms' END AS timestamp_unit,
  make_timestamp(arg_min(open_time, line_no) * 1000) AS first_open_time_utc, make_timestamp(arg_max(open_time, line_no) * 1000) AS last_open_time_utc, count(*) - count(DISTINCT open_time) AS duplicates, count(*) FILTER (diff <= 0) AS non_monotonic,
  count(*) FILTER (diff > 60000) AS gaps, coalesce(sum(diff // 60000 - 1) FILTER (diff > 60000), 0)::BIGINT AS missing_minutes FROM d GROUP BY symbol, month""")
def file_profiles(spark, sf_dir):
    steps = windowed(files(spark, sf_dir).withColumn("name", F.concat_ws("/", "symbol", "month")), {"diff": lambda w: F.col("open_time") - F.lag("open_time").over(w)}, 1, key="name", t="line_no", stretch=F.floor(F.col("line_no") / 100_000))
    unit = keys.epoch_unit(F.min_by("open_time", "line_no"))
    at = lambda c: F.timestamp_millis(c).cast("timestamp_ntz")
    return steps.groupBy("symbol", "month").agg(
        F.count("*").alias("rows"), (F.dayofmonth(F.last_day(F.to_date(F.first("month"), "yyyy-MM"))) * 1440).cast("long").alias("rows_expected"), unit.alias("timestamp_unit"),
        at(F.min_by("open_time", "line_no")).alias("first_open_time_utc"), at(F.max_by("open_time", "line_no")).alias("last_open_time_utc"), (F.count("*") - F.count_distinct("open_time")).alias("duplicates"), F.count_if(F.col("diff") <= 0).alias("non_monotonic"),
        F.count_if(F.col("diff") > 60_000).alias("gaps"), F.coalesce(F.sum(F.when(F.col("diff") > 60_000, F.floor(F.col("diff") / 60_000) - 1)), F.lit(0)).alias("missing_minutes"),
    )


@query("file_heads", f"WITH {_FILES} SELECT symbol, month, line_no, open_time, value FROM files WHERE line_no < 3")
def file_heads(spark, sf_dir):
    return files(spark, sf_dir).where("line_no < 3").select("symbol", "month", "line_no", "open_time", "value")


@query("daily_counts", f"WITH {_DIRTY} SELECT symbol, strftime(t, '%Y-%m-%d') AS day, count(*) AS rows, count(*) FILTER (volume = 0) AS zero_volume, 24 - count(DISTINCT slot) AS missing FROM dirty GROUP BY ALL")
def daily_counts(spark, sf_dir):
    return dirty(spark, sf_dir).groupBy("symbol", F.date_format("t", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("rows"), F.count_if(F.col("volume") == 0).alias("zero_volume"), (F.lit(24).cast("long") - F.count_distinct("slot")).alias("missing"))


@query("window_trim", f"WITH {_BARS} SELECT symbol, count(*) AS rows, min(t) AS first_t, max(t) AS last_t FROM bars WHERE t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-25' GROUP BY symbol")
def window_trim(spark, sf_dir):
    from tidemark.registry import Config

    return Config(window=("2024-01-05", "2024-01-24")).inside(bars(spark, sf_dir), "t").groupBy("symbol").agg(F.count("*").alias("rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


_FLAT = _BARS + ", fillers AS (SELECT symbol, slot, t FROM (SELECT *, CASE WHEN slot % 11 < 5 THEN 0 ELSE volume END AS v FROM bars) WHERE v = 0 AND open = high AND high = low AND low = close)"


@query("flat_filler_runs", f"WITH {_FLAT} " + _RUNS.format("fillers"))
def flat_filler_runs(spark, sf_dir):
    every = bars(spark, sf_dir).withColumn("volume", F.when(F.col("slot") % 11 < 5, 0.0).otherwise(F.col("volume")))
    return profile.runs(every.where(keys.is_filler(*(F.col(c) for c in ("open", "high", "low", "close", "volume")))).select("symbol", "slot", "t"))


@query("funding_census", f"WITH {_BARS}, f AS (SELECT symbol, slot, close, slot - lag(slot) OVER (PARTITION BY symbol ORDER BY slot) AS gap FROM bars WHERE slot % 8 = 0) SELECT symbol, count(*) AS records, count(DISTINCT gap) AS intervals, min(gap) AS least_interval, max(gap) AS most_interval, min(close) AS min_rate, max(close) AS max_rate FROM f GROUP BY symbol")
def funding_census(spark, sf_dir):
    rows = profile.steps(bars(spark, sf_dir).where("slot % 8 = 0"))
    return rows.groupBy("symbol").agg(F.count("*").alias("records"), F.count_distinct("diff").alias("intervals"), F.min("diff").alias("least_interval"), F.max("diff").alias("most_interval"), F.min("close").alias("min_rate"), F.max("close").alias("max_rate"))


# Waves

_MOVING = f"""{_BARS}, u AS (SELECT symbol, slot, close, round(stddev_samp(close) OVER (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 9) / close AS unit FROM bars),
s AS (SELECT symbol, k AS theta, slot, close, k * unit AS r, row_number() OVER (PARTITION BY symbol, k ORDER BY slot) AS i FROM u, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) v(k)),
fold AS (
  SELECT symbol, theta, i, slot, close, 0 AS dir, close AS hi, slot AS hi_at, close AS lo, slot AS lo_at, 0 AS ev, 0::BIGINT AS ev_at, 0::DOUBLE AS ev_px FROM s WHERE i = 1
  UNION ALL
  SELECT symbol, theta, i, slot, close,
    CASE WHEN up_ev THEN 1 WHEN dn_ev THEN -1 ELSE dir END, CASE WHEN up_ev OR dn_ev THEN close ELSE nhi END, CASE WHEN up_ev OR dn_ev THEN slot ELSE nhi_at END, CASE WHEN up_ev OR dn_ev THEN close ELSE nlo END, CASE WHEN up_ev OR dn_ev THEN slot ELSE nlo_at END,
    CASE WHEN up_ev THEN 1 WHEN dn_ev THEN -1 ELSE 0 END, CASE WHEN up_ev THEN nlo_at ELSE nhi_at END, CASE WHEN up_ev THEN nlo ELSE nhi END
  FROM (SELECT *, dir = -1 AND close >= lo * (1 + r) AND close >= lo OR dir = 0 AND close >= nlo * (1 + r) AS up_ev, dir = 1 AND close <= hi * (1 - r) AND close <= hi OR dir = 0 AND NOT close >= nlo * (1 + r) AND close <= nhi * (1 - r) AS dn_ev FROM (
    SELECT s.symbol, s.theta, s.i, s.slot, s.close, coalesce(s.r, 1e300) AS r, f.dir, f.hi, f.lo, greatest(f.hi, s.close) AS nhi, CASE WHEN s.close > f.hi THEN s.slot ELSE f.hi_at END AS nhi_at, least(f.lo, s.close) AS nlo, CASE WHEN s.close < f.lo THEN s.slot ELSE f.lo_at END AS nlo_at
    FROM fold f JOIN s ON s.symbol = f.symbol AND s.theta = f.theta AND s.i = f.i + 1))
), changes AS (SELECT symbol, theta, ev AS direction, ev_at AS extreme_slot, ev_px AS extreme, slot AS confirm_slot, close AS confirm FROM fold WHERE ev <> 0)"""


def with_unit(spark, sf_dir):
    """Bars with their sigma of the 24 closes before, as a share of the close."""
    return pointintime.sigma(bars(spark, sf_dir), 24).withColumn("unit", F.col("sigma") / F.col("close"))


@query("sigma_waves", f"WITH RECURSIVE {_MOVING} SELECT symbol, theta, direction, extreme_slot, extreme, confirm_slot, confirm FROM changes")
def sigma_waves(spark, sf_dir):
    return waves.directional_changes(with_unit(spark, sf_dir), [0.5, 1.0, 2.0], "unit")


@query("wave_retracement", f"WITH RECURSIVE {_SEGMENTS} SELECT symbol, theta, direction, start_slot, round(amplitude / bars, 9) AS speed, round(abs(amplitude / lag(amplitude) OVER (PARTITION BY symbol, theta ORDER BY start_slot)), 6) AS retracement FROM segs")
def wave_retracement(spark, sf_dir):
    return waves.with_retracement(waves.segments(changes(spark, sf_dir))).select("symbol", "theta", "direction", "start_slot", "speed", "retracement")


_STATE = "CASE WHEN direction = 1 THEN 'up' ELSE 'down' END || CASE WHEN bars > 3 THEN ' long' ELSE ' short' END"


@query("wave_transitions", f"""WITH RECURSIVE {_SEGMENTS}, st AS (SELECT symbol, theta, start_slot, {_STATE} AS after FROM segs), pr AS (SELECT *, lag(after) OVER (PARTITION BY symbol, theta ORDER BY start_slot) AS before FROM st),
ct AS (SELECT symbol, theta, before, after, count(*) AS waves FROM pr WHERE before IS NOT NULL GROUP BY ALL) SELECT *, round(waves / sum(waves) OVER (PARTITION BY symbol, theta, before), 6) AS share FROM ct""")
def wave_transitions(spark, sf_dir):
    return waves.transitions(waves.segments(changes(spark, sf_dir)), F.expr(_STATE))


_GRID = [round(0.2 + 0.1 * i, 1) for i in range(8)]


@query("wave_grid", "WITH RECURSIVE " + _SEGMENTS.replace("(VALUES (0.3::DOUBLE), (0.6::DOUBLE), (0.9::DOUBLE)) v(theta)", "(SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in _GRID) + "]) AS theta) v") + " SELECT theta, count(*) AS waves, round(avg(abs(amplitude)), 6) AS mean_amplitude, round(avg(bars), 6) AS mean_bars FROM segs GROUP BY theta")
def wave_grid(spark, sf_dir):
    """Statistics of waves over a grid of thresholds."""
    return waves.segments(changes(spark, sf_dir, _GRID)).groupBy("theta").agg(F.count("*").alias("waves"), F.round(F.avg(F.abs("amplitude")), 6).alias("mean_amplitude"), F.round(F.avg("bars"), 6).alias("mean_bars"))


@query("sideways_narrow", f"""WITH RECURSIVE {_CHANGES}, e AS (SELECT symbol, confirm_slot FROM changes WHERE theta = 0.6),
r AS (SELECT symbol, slot, max(high) OVER w - min(low) OVER w AS width, round(stddev_samp(close) OVER (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 9) AS sigma FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT b.symbol, b.slot FROM r b ASOF JOIN e ON b.symbol = e.symbol AND b.slot >= e.confirm_slot WHERE b.slot - e.confirm_slot >= 3 AND width < 5 * sigma""")
def sideways_narrow(spark, sf_dir):
    """No large change for three steps, and a range of three bars below five sigma."""
    every = bars(spark, sf_dir)
    confirmed = changes(spark, sf_dir, [0.6]).select("symbol", F.col("confirm_slot").alias("slot"), F.col("confirm_slot").alias("last"))
    events = every.select("symbol", "slot", "t").join(confirmed, ["symbol", "slot"]).select("symbol", "t", "last")
    frame = lambda w: w.rowsBetween(-2, 0)
    ranged = windowed(pointintime.sigma(every, 24), {"width": lambda w: F.max("high").over(frame(w)) - F.min("low").over(frame(w))}, 2)
    out = pointintime.as_of(ranged.select("symbol", "t", "slot", "width", "sigma"), events, "last", "last")
    return out.where("slot - last >= 3 AND width < 5 * sigma").select("symbol", "slot")


# Labels and tests

_SIGMA_BARRIERS = """widths AS (SELECT symbol, slot, round(stddev_samp(close) OVER (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 9) / close AS unit FROM bars)
SELECT e.symbol, e.slot, coalesce(first(CASE WHEN b.low <= e.close * (1 - 1.5 * unit) THEN -1 ELSE 1 END ORDER BY b.slot) FILTER (b.slot IS NOT NULL), 0) AS barrier, coalesce(min(b.slot), e.slot + 12) AS exit_slot
FROM signals e JOIN widths w ON w.symbol = e.symbol AND w.slot = e.slot LEFT JOIN bars b ON b.symbol = e.symbol AND b.slot > e.slot AND b.slot <= e.slot + 12 AND (b.low <= e.close * (1 - 1.5 * unit) OR b.high >= e.close * (1 + 2.0 * unit)) WHERE e.signal <> 0 GROUP BY e.symbol, e.slot"""


@query("triple_barrier_sigma", f"WITH {_BREAKOUT}, {_SIGMA_BARRIERS}")
def triple_barrier_sigma(spark, sf_dir):
    every = bars(spark, sf_dir)
    unit = with_unit(spark, sf_dir).select("symbol", "slot", "unit")
    events = pointintime.breakout(every, 12).where("signal <> 0").join(unit, ["symbol", "slot"])
    return labels.triple_barrier(events, every, 2.0, 1.5, 12, "unit")


@query("event_clusters_all", f"""WITH {_BREAKOUT}, {_BARRIERS}, c AS (SELECT *, CASE WHEN slot <= max(exit_slot) OVER (ORDER BY slot, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM barriers),
g AS (SELECT *, sum(fresh) OVER (ORDER BY slot, symbol ROWS UNBOUNDED PRECEDING) AS cluster FROM c) SELECT min(slot) AS start_slot, max(exit_slot) AS end_slot, count(*) AS events FROM g GROUP BY cluster""")
def event_clusters_all(spark, sf_dir):
    """Clusters of labels that overlap in time, over all symbols."""
    rows = barriers(spark, sf_dir).groupBy("slot").agg(F.max("exit_slot").alias("end_slot"), F.count("*").alias("c"))
    rows = rows.select(F.lit("all").alias("symbol"), F.timestamp_seconds(F.col("slot") * 3600).cast("timestamp_ntz").alias("t"), "slot", "end_slot", "c")
    return stats.merged_intervals(settle(rows, "intervals"), F.sum("c")).drop("symbol")


@query("promotion_gate", f"""WITH {_TESTS}, span AS (SELECT min(slot) AS lo, max(slot) AS hi FROM bars), o AS (SELECT symbol, (slot % 24)::BIGINT AS hour, round(avg(ret), 9) AS expectancy FROM returns, span WHERE ret IS NOT NULL AND {_SPLIT.format('slot')} = 'validation' GROUP BY ALL)
SELECT symbol, hour, z, expectancy FROM tests JOIN o USING (symbol, hour) WHERE z > 1 AND expectancy > 0.05""")
def promotion_gate(spark, sf_dir):
    """Hours whose return looks good and is so on validation rows too."""
    rows = settle(evaluation.with_split(returns(spark, sf_dir)).where("ret IS NOT NULL").withColumn("hour", F.col("slot") % 24).withColumn("name", F.concat_ws("-", "symbol", F.col("hour").cast("string"))), "returns")
    tests = rows.groupBy("symbol", "hour", "name").agg(F.count("*").alias("n"), F.round(F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.count("*")), 6).alias("z")).where("n > 2 AND z > 1")
    seen = rows.where("split = 'validation'").groupBy("name").agg(F.round(F.avg("ret"), 9).alias("expectancy"))
    return evaluation.promoted(tests, seen, "name", 0.05).join(seen, "name").select("symbol", "hour", "z", "expectancy")


@query("forward_holdout", f"WITH {_BARS} SELECT symbol, CASE WHEN t >= TIMESTAMP '2024-01-26' THEN 'holdout' ELSE 'research' END AS part, count(*) AS rows FROM bars GROUP BY ALL")
def forward_holdout(spark, sf_dir):
    from tidemark.registry import Config

    return Config(holdout_from="2024-01-26").parts(bars(spark, sf_dir), "t").groupBy("symbol", "part").agg(F.count("*").alias("rows"))


@query("walk_forward_all", f"""WITH {_BARS}, x AS (SELECT min(slot) AS lo, max(slot) AS hi FROM bars), f AS (SELECT fold::INTEGER AS fold, lo + 240 + fold * 72 AS start, slot FROM bars, x, LATERAL (SELECT unnest(range(greatest(0, (hi - lo + 1 - 240 + 71) // 72))) AS fold) r)
SELECT fold, CASE WHEN slot >= start THEN 'test' ELSE 'train' END AS part, count(*) AS rows FROM f WHERE slot >= start AND slot < start + 72 OR slot + 4 < start GROUP BY ALL""")
def walk_forward_all(spark, sf_dir):
    """As many folds as the table's span holds."""
    every = bars(spark, sf_dir)
    first, last = every.agg(F.min("slot"), F.max("slot")).first()
    return evaluation.walk_forward(every, first, 240, 72, evaluation.fold_count(first, last, 240, 72), 4)


@query("truncation_counts", f"""WITH {_BARS}, m AS (SELECT (min(slot) + max(slot)) // 2 AS m FROM bars), w AS (SELECT symbol, slot, m, CASE WHEN close > lag(close) OVER w THEN 1 ELSE 0 END AS past, CASE WHEN lead(close) OVER w > close THEN 1 ELSE 0 END AS future FROM bars, m WINDOW w AS (PARTITION BY symbol ORDER BY slot)),
c AS (SELECT symbol, slot, past, future FROM (SELECT symbol, slot, CASE WHEN close > lag(close) OVER w THEN 1 ELSE 0 END AS past, CASE WHEN lead(close) OVER w > close THEN 1 ELSE 0 END AS future FROM bars, m WHERE slot <= m WINDOW w AS (PARTITION BY symbol ORDER BY slot)))
SELECT w.symbol, count(*) AS rows, count(*) FILTER (w.past <> c.past) AS past_differs, count(*) FILTER (w.future <> c.future) AS future_differs FROM w JOIN c USING (symbol, slot) GROUP BY w.symbol""")
def truncation_counts(spark, sf_dir):
    """A feature of the past is the same on the table cut in the middle; one that looks ahead isn't."""
    every = bars(spark, sf_dir)
    middle = every.agg(F.floor((F.min("slot") + F.max("slot")) / 2)).first()[0]

    def both(rows, name):
        rise = lambda a, b: F.when(F.col(a) > F.col(b), 1).otherwise(0)
        near = windowed(rows, {"before": lambda w: F.lag("close").over(w), "after": lambda w: F.lead("close").over(w)}, 1, 1)
        return near.select("symbol", "slot", rise("close", "before").alias("past" + name), rise("after", "close").alias("future" + name))

    pairs = both(every, "").join(both(every.where(F.col("slot") <= middle), "_cut"), ["symbol", "slot"])
    return pairs.groupBy("symbol").agg(F.count("*").alias("rows"), F.count_if(F.expr("past <> past_cut")).alias("past_differs"), F.count_if(F.expr("future <> future_cut")).alias("future_differs"))


@query("trade_funding", f"""WITH {_BREAKOUT}, {_TRADES}, f AS (SELECT symbol, slot, 0.0001 * n AS rate FROM bars WHERE slot % 8 = 0),
p AS (SELECT t.symbol, t.slot, any_value(t.gross) AS gross, coalesce(sum(-t.signal * f.rate), 0) AS funding FROM trades t LEFT JOIN f ON f.symbol = t.symbol AND f.slot > t.slot AND f.slot <= t.slot + 4 WHERE delay = 0 GROUP BY ALL)
SELECT symbol, count(*) AS trades, round(sum(funding), 9) AS funding, round(sum(gross + funding - 0.0012), 6) AS net FROM p GROUP BY symbol""")
def trade_funding(spark, sf_dir):
    rates = bars(spark, sf_dir).where("slot % 8 = 0").select("symbol", "slot", (F.lit(0.0001) * F.col("n")).alias("rate"))
    rows = evaluation.funded(settle(_trades(spark, sf_dir), "trades"), rates, 4)
    return rows.groupBy("symbol").agg(F.count("*").alias("trades"), F.round(F.sum("funding"), 9).alias("funding"), F.round(F.sum(evaluation.net(F.col("gross"), 0.0005, 0.0001) + F.col("funding")), 6).alias("net"))


@query("winner_trim", f"""WITH {_BREAKOUT}, {_TRADES}, r AS (SELECT *, row_number() OVER (ORDER BY gross, symbol, slot) - 1 AS place, count(*) OVER () AS total FROM trades WHERE delay = 0)
SELECT symbol, count(*) AS trades, round(sum(gross - 0.0012), 6) AS net FROM r WHERE place < total - floor(total * 5 / 100) GROUP BY symbol""")
def winner_trim(spark, sf_dir):
    """Profit without the best twentieth of all trades, by symbol."""
    rows = evaluation.trimmed(settle(_trades(spark, sf_dir), "trades"), 5)
    return rows.groupBy("symbol").agg(F.count("*").alias("trades"), F.round(F.sum(evaluation.net(F.col("gross"), 0.0005, 0.0001)), 6).alias("net"))


_NEIGHBOURS = " UNION ALL ".join(f"""SELECT {n} AS lookback, {h} AS hold, calm, s.signal * (l.open / e.open - 1) AS gross FROM (SELECT symbol, slot, n <= 2 AS calm, CASE WHEN close > max(high) OVER w THEN 1 WHEN close < min(low) OVER w THEN -1 ELSE 0 END AS signal FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)) s JOIN bars e ON e.symbol = s.symbol AND e.slot = s.slot + 1 JOIN bars l ON l.symbol = s.symbol AND l.slot = s.slot + 1 + {h} WHERE s.signal <> 0""" for n, h in ((10, 4), (12, 4), (14, 4), (12, 3), (12, 5)))


@query("robustness_neighbours", f"WITH {_BARS}, t AS ({_NEIGHBOURS}) SELECT lookback, hold, calm, count(*) AS trades, round(sum(gross - 0.0012), 6) AS net FROM t GROUP BY ALL")
def robustness_neighbours(spark, sf_dir):
    """Profit with neighbouring parameters, by regime (bars of at most two events are calm)."""
    every = settle(bars(spark, sf_dir), "bars")
    out = None
    for n, h in ((10, 4), (12, 4), (14, 4), (12, 3), (12, 5)):
        rows = evaluation.trades(pointintime.breakout(every, n).where("signal <> 0"), every, h).join(every.select("symbol", "slot", (F.col("n") <= 2).alias("calm")), ["symbol", "slot"])
        sums = rows.groupBy("calm").agg(F.count("*").alias("trades"), F.round(F.sum(evaluation.net(F.col("gross"), 0.0005, 0.0001)), 6).alias("net")).select(F.lit(n).alias("lookback"), F.lit(h).alias("hold"), "calm", "trades", "net")
        out = sums if out is None else out.unionByName(sums)
    return out


@query("reality_check", f"""WITH {_BARS}, {_RETURNS}, d AS (SELECT symbol, slot // 24 AS day, sum(ret) AS s, count(*) AS n FROM returns WHERE ret IS NOT NULL GROUP BY ALL), x AS (SELECT min(day) AS first, max(day) - min(day) + 1 AS m FROM d),
r AS (SELECT rep, first + (1103515245::BIGINT * rep + 12345::BIGINT * i * i + 6700417::BIGINT * (rep + 1) * i + 97) % 2147483647 % m AS day FROM x, range(50) q(rep), LATERAL (SELECT unnest(range(m)) AS i) y),
b AS (SELECT rep, symbol, sum(s) / sum(n) AS mean FROM r JOIN d USING (day) GROUP BY ALL), o AS (SELECT symbol, sum(s) / sum(n) AS own FROM d GROUP BY symbol),
e AS (SELECT rep, round(max(mean - own), 6) AS best_excess, round(max(own), 6) AS best FROM b JOIN o USING (symbol) GROUP BY rep)
SELECT count(*) AS replicates, max(best) AS best, round((count(*) FILTER (best_excess >= best) + 1) / (count(*) + 1), 6) AS p FROM e""")
def reality_check(spark, sf_dir):
    """The p-value of White's reality check: how often the best resampled excess reaches the best mean."""
    from tidemark.plans.catalogue import spa

    return spa(spark, sf_dir).agg(F.count("*").alias("replicates"), F.max("best").alias("best"), F.round((F.count_if(F.col("best_excess") >= F.col("best")) + 1) / (F.count("*") + 1), 6).alias("p"))
