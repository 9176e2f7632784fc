"""Registered queries over archives: bars of the events table are exported as zip archives below the shared folder, and read
back through the archive source.  They are added to the catalogue's when this is imported."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.plans.catalogue import _BARS, bars, query
from tidemark.plans.tables import settled_root
from tidemark.sources import archive

HEADER = archive.HEADER
#: A month's archive of each symbol but clicks, without a header; and one of each day: every third with a header, every
#: fifth without a checksum, every seventh with a wrong one, every eleventh in microseconds.
_FILES = f"""{_BARS}, tiers AS (SELECT *, symbol || '/' || symbol || '-1m-' || strftime(t, '%Y-%m') || '.zip' AS key, 0 AS d FROM bars WHERE symbol <> 'click' UNION ALL SELECT *, symbol || '/' || symbol || '-1m-' || strftime(t, '%Y-%m-%d') || '.zip' AS key, day(t) AS d FROM bars),
lines AS (SELECT *, CASE WHEN d % 11 = 0 AND d > 0 THEN 'us' ELSE 'ms' END AS unit, CASE WHEN d % 11 = 0 AND d > 0 THEN 1000 ELSE 1 END AS scale FROM tiers),
texts AS (SELECT *, slot * 3600000 * scale AS open_time, printf('%d,%.2f,%.2f,%.2f,%.2f,%.2f,%d,%.2f,%d,0,0,0', slot * 3600000 * scale, open, high, low, close, volume, (slot * 3600000 + 3599999) * scale, volume, n) AS line FROM lines),
files AS (SELECT *, d % 3 = 0 AND d > 0 AS has_header, d = 0 OR d % 5 <> 0 AND d % 7 <> 0 AS sha256_ok, row_number() OVER (PARTITION BY key ORDER BY slot) AS i FROM texts)"""


def exported(spark, sf_dir) -> str:
    """The folder below which a new export of the table's bars lies."""
    every = bars(spark, sf_dir)
    name = lambda form: F.concat("symbol", F.lit("/"), "symbol", F.lit("-1m-"), F.date_format("t", form), F.lit(".zip")).alias("key")
    tiers = every.where("symbol <> 'click'").select("*", name("yyyy-MM"), F.lit(0).alias("d")).unionByName(every.select("*", name("yyyy-MM-dd"), F.dayofmonth("t").alias("d")))
    scale = F.when((F.col("d") % 11 == 0) & (F.col("d") > 0), 1000).otherwise(1)
    start = F.col("slot") * 3_600_000
    line = F.format_string("%d,%.2f,%.2f,%.2f,%.2f,%.2f,%d,%.2f,%d,0,0,0", start * scale, "open", "high", "low", "close", "volume", (start + 3_599_999) * scale, "volume", "n")
    sums = F.when((F.col("d") > 0) & (F.col("d") % 5 == 0), "").when((F.col("d") > 0) & (F.col("d") % 7 == 0), "0" * 64)
    lines = tiers.select("key", "d", F.col("slot").alias("line_no"), line.alias("line"), sums.alias("checksum"))
    headers = lines.where("d % 3 = 0 AND d > 0").select("key", "d", F.lit(-1).cast("long").alias("line_no"), F.lit(HEADER).alias("line"), "checksum").distinct()
    root = f"{settled_root(spark)}/tidemark/export-{uuid.uuid4().hex}"
    archive.write_archives(lines.unionByName(headers), root)
    return root


@query("archive_names", f"WITH {_FILES} SELECT DISTINCT key, regexp_extract(key, '([0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?)[.]zip$', 1) AS date FROM files")
def archive_names(spark, sf_dir):
    return archive.objects(spark, exported(spark, sf_dir)).select("key", "date")


@query("archive_profiles", f"""WITH {_FILES}, s AS (SELECT *, open_time - lag(open_time) OVER (PARTITION BY key ORDER BY i) AS diff, 60000 * scale AS step FROM files)
SELECT key, bool_and(sha256_ok) AS sha256_ok, bool_and(has_header) AS has_header, CASE WHEN bool_and(has_header) THEN '{HEADER}' ELSE min(line) FILTER (i = 1) END AS first_line, (sum(length(line) + 1) + CASE WHEN bool_and(has_header) THEN {len(HEADER) + 1} ELSE 0 END)::BIGINT AS csv_bytes,
  CASE WHEN bool_and(has_header) THEN '{HEADER}' END AS columns, string_agg(line, '|' ORDER BY i) FILTER (i <= 3) AS head, count(*) AS rows, day(last_day(any_value(t)))::BIGINT * 1440 AS rows_expected, any_value(unit) AS unit, min(t) AS first_open_time_utc, max(t) AS last_open_time_utc,
  0::BIGINT AS duplicates, 0::BIGINT AS non_monotonic, count(*) FILTER (diff > step) AS gaps, coalesce(sum(diff // step - 1) FILTER (diff > step), 0)::BIGINT AS missing_minutes, any_value(3599999::BIGINT * scale) AS span_mode, 0::BIGINT AS ohlc_violations, 0::BIGINT AS negative_values, 0::BIGINT AS zero_volume FROM s GROUP BY key""")
def archive_profiles(spark, sf_dir):
    """The whole profile of every archive: checksum, header, head, sizes, expected rows, times, gaps and price checks."""
    out = archive.profiles(archive.archived_lines(spark, exported(spark, sf_dir)))
    joined = {c: F.array_join(c, by) for c, by in (("columns", ","), ("head", "|"))}
    return out.withColumns(joined).drop("zip_bytes", "error")


@query("archive_manifest", f"WITH {_FILES} SELECT key, CASE WHEN bool_and(sha256_ok) THEN 'verified' ELSE 'rejected' END AS status FROM files GROUP BY key")
def archive_manifest(spark, sf_dir):
    return archive.manifest_rows(archive.archives(spark, exported(spark, sf_dir))).select("key", "status")


@query("archive_rows", f"WITH {_FILES} SELECT key, symbol, t AS open_ts, open, high, low, close, volume, n AS count, year(t)::INTEGER AS year, month(t)::INTEGER AS month, volume = 0 AND open = high AND high = low AND low = close AS is_filler FROM files WHERE sha256_ok")
def archive_rows(spark, sf_dir):
    """Rows as they are stored, of the archives whose checksums are right."""
    lines = archive.archived_lines(spark, exported(spark, sf_dir)).where("sha256_ok AND line_no >= 0")
    rows = archive.normalised(archive.parse(lines, archive.KLINES), F.split("key", "/")[0])
    return rows.select("key", "symbol", "open_ts", "open", "high", "low", "close", "volume", "count", "year", "month", "is_filler")


@query("archive_series", f"""WITH {_FILES} SELECT symbol, t AS open_ts, close, length(regexp_extract(key, '([0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?)[.]zip$', 1)) = 7 AS monthly FROM files f
WHERE t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-25' AND (d = 0 OR symbol = 'click')""")
def archive_series(spark, sf_dir):
    """One series a symbol: the month's archive where there is one, and the days' otherwise, cut to the window."""
    rows = archive.parse(archive.archived_lines(spark, exported(spark, sf_dir)).where("line_no >= 0"), archive.KLINES).withColumn("symbol", F.split("key", "/")[0])
    out = archive.merged_tiers(rows, "2024-01-05", "2024-01-24")
    return out.select("symbol", "open_ts", "close", (~F.col("key").rlike("-[0-9]{2}-[0-9]{2}[.]zip$")).alias("monthly"))
