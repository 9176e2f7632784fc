"""Archived CSV files: listing, checksums, decoding, manifest and normalised storage.

One task decodes one archive at a time; a zip can't be split, so parallelism is the number of files.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import date_of, epoch_unit, is_filler, negative_cells, ohlc_violation
from tidemark.plans.tables import settle
from tidemark.sources.store import ArchiveSource, FileStore
from tidemark.sources.store import lines_of as first_member

# The columns of archived files, in their order.
KLINES = "open_time BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, close_time BIGINT, quote_volume DOUBLE, count BIGINT, taker_buy_volume DOUBLE, taker_buy_quote_volume DOUBLE, ignore STRING"
METRICS = "create_time STRING, symbol STRING, sum_open_interest DOUBLE, sum_open_interest_value DOUBLE, count_toptrader_long_short_ratio DOUBLE, sum_toptrader_long_short_ratio DOUBLE, count_long_short_ratio DOUBLE, sum_taker_long_short_vol_ratio DOUBLE"
FUNDING = "calc_time BIGINT, funding_interval_hours INT, last_funding_rate DOUBLE"
#: The header that some archives of bars begin with.
HEADER = ",".join(c.split()[0] for c in KLINES.split(", "))
STEP_MS = 60_000


def _read(spark: SparkSession, root: str, rows: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the source takes filters, which Spark has to allow
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archives").option("rows", rows).load(root)


def objects(spark: SparkSession, root: str) -> DataFrame:
    """(key, length, date) of all archives below ``root``, by their names below it; nothing is read."""
    return _read(spark, root, "names")


def archives(spark: SparkSession, root: str) -> DataFrame:
    """(key, content, sha256, expected, sha256_ok): a missing checksum file counts as not matching.  An archive and its
    checksum are read by one task."""
    return _read(spark, root, "contents").select("key", "content", "sha256", "expected", "sha256_ok")


def archived_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of all archives, with their archives' sizes and checksums; see ``store.ArchiveSource``."""
    return _read(spark, root, "lines")


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for key, content in zip(batch["key"], batch["content"]):
            for numbers, lines, error in first_member(content):
                yield pd.DataFrame({"key": key, "line_no": numbers, "line": lines, "error": [None] * (len(lines) - 1) + [error]})


def decoded(zips: DataFrame) -> DataFrame:
    """(key, line_no, line, error) of the first member of each archive; an archive that is empty, cut short or none at
    all gives, after what could be read, one row of line_no -1 that says why."""
    return zips.select("key", "content").mapInPandas(_decode, "key string, line_no long, line string, error string")


def decode(zips: DataFrame) -> DataFrame:
    """(key, line_no, line) of the first member of each archive; file order is data, so lines are numbered.  Broken
    archives give what could be read; see ``decoded``."""
    return decoded(zips).where("line_no >= 0").drop("error")


def write_archives(lines: DataFrame, root: str) -> DataFrame:
    """(key, bytes, sha256) of the archives written below ``root``, one for each key of lines(key, line_no, line, checksum):
    the lines in order, and beside them their checksum, or the one given; an empty one is left out.

    A task writes whole archives, each a month of one symbol at most; equal lines give equal bytes, so that an archive that
    is written again after a lost executor is the same."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("line_no"), io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            member = zipfile.ZipInfo(key[0].rpartition("/")[2].removesuffix(".zip") + ".csv")  # its time is a fixed one
            archive.writestr(member, "\n".join(rows["line"]) + "\n", zipfile.ZIP_DEFLATED)
        content, given, store = out.getvalue(), rows["checksum"].iloc[0], FileStore(root)
        sha = hashlib.sha256(content).hexdigest()
        store.put(key[0], content)
        if given != "":
            store.put(key[0] + ".CHECKSUM", f"{given or sha}  {key[0].rpartition('/')[2]}\n".encode())
        return pd.DataFrame([(key[0], len(content), sha)], columns=["key", "bytes", "sha256"])

    return settle(lines.select("key", "line_no", "line", "checksum").groupBy("key").applyInPandas(one, "key string, bytes long, sha256 string"), "written")


def accepted(zips: DataFrame) -> DataFrame:
    """Archives that may be decoded and stored: those whose checksum was there and right."""
    return zips.where("sha256_ok")


def parse(lines: DataFrame, schema: str) -> DataFrame:
    """Typed rows with (key, line_no); a first line that doesn't begin with a digit is a header and left out."""
    header = (F.col("line_no") == 0) & ~F.col("line").rlike("^[0-9]")
    return lines.where(~header & (F.col("line") != "")).select("key", "line_no", F.from_csv("line", schema).alias("r")).select("key", "line_no", "r.*")


def file_profile(lines: DataFrame) -> DataFrame:
    """(key, rows, has_header, first_line, csv_bytes, columns, head): the first line cut to 200 characters, the header's
    names, and the first three rows as they are written."""
    first = F.max(F.when(F.col("line_no") == 0, F.col("line")))
    header = ~first.rlike("^[0-9]")
    early = F.array_sort(F.collect_list(F.when(F.col("line_no") < 4, F.struct("line_no", "line"))))  # four lines
    out = lines.groupBy("key").agg(F.count_if(F.col("line") != "").alias("lines"), first.alias("first"), header.alias("has_header"), F.sum(F.octet_length("line") + 1).alias("csv_bytes"), early.alias("early"))
    head = F.slice(F.filter("early", lambda x: ~F.col("has_header") | (x["line_no"] > 0)), 1, 3)
    return out.select("key", (F.col("lines") - F.col("has_header").cast("int")).alias("rows"), "has_header", F.substring("first", 1, 200).alias("first_line"), "csv_bytes",
                      F.when(F.col("has_header"), F.split("first", ",")).alias("columns"), F.transform(head, lambda x: x["line"]).alias("head"))


def kline_profile(rows: DataFrame) -> DataFrame:
    """One row an archive: unit, rows expected of its month, first and last time, duplicates, disorder, gaps, missing
    minutes and price checks, in file order.

    A file is one month of one symbol at most, so a window over one file is bounded."""
    from pyspark.sql import Window

    first = Window.partitionBy("key").orderBy("line_no")
    unit = epoch_unit(F.first("open_time").over(first))
    timed = rows.withColumn("unit", unit).withColumn("step", F.when(F.col("unit") == "us", STEP_MS * 1000).otherwise(STEP_MS)).withColumn("diff", F.col("open_time") - F.lag("open_time").over(first))
    price = [F.col(c) for c in ("open", "high", "low", "close")]
    utc = lambda c: F.when(F.first("unit") == "us", F.timestamp_micros(c)).otherwise(F.timestamp_millis(c)).cast("timestamp_ntz")
    month = F.to_date(F.substring(date_of(F.first("key")), 1, 7), "yyyy-MM")
    return timed.groupBy("key", "unit").agg(
        F.count("*").alias("rows"), (F.dayofmonth(F.last_day(month)) * 1440).cast("long").alias("rows_expected"), utc(F.min_by("open_time", "line_no")).alias("first_open_time_utc"), utc(F.max_by("open_time", "line_no")).alias("last_open_time_utc"),
        (F.count("*") - F.count_distinct("open_time")).alias("duplicates"), F.count_if(F.col("diff") <= 0).alias("non_monotonic"), F.count_if(F.col("diff") > F.col("step")).alias("gaps"),
        F.coalesce(F.sum(F.when(F.col("diff") > F.col("step"), F.floor(F.col("diff") / F.col("step")) - 1)), F.lit(0)).alias("missing_minutes"), F.mode(F.col("close_time") - F.col("open_time"), True).alias("span_mode"),
        F.count_if(ohlc_violation(*price)).alias("ohlc_violations"), F.sum(negative_cells(*price, F.col("volume"))).alias("negative_values"), F.count_if(F.col("volume") == 0).alias("zero_volume"),
    )


def profiles(lines: DataFrame, schema: str = KLINES) -> DataFrame:
    """The whole profile of each archive of ``archived_lines``: checksum and sizes, header and head, and what
    ``kline_profile`` counts.  Archives are decoded once: the two profiles and the checksum are taken from written lines."""
    lines = settle(lines, "lines")
    meta = lines.groupBy("key").agg(F.first("sha256_ok").alias("sha256_ok"), F.first("zip_bytes").alias("zip_bytes"), F.max("error").alias("error"))
    good = lines.where("line_no >= 0").select("key", "line_no", "line")
    return meta.join(file_profile(good), "key", "left").join(kline_profile(parse(good, schema)).drop("rows"), "key", "left")


def merged_tiers(rows: DataFrame, start: str, end: str) -> DataFrame:
    """One series of rows(symbol, key, open_time, ...) of monthly and daily archives: the months', and the days' of months
    that a symbol has none of, from the day ``start`` to the end of the day ``end``, of each time once."""
    dated = rows.withColumn("date", date_of(F.col("key"))).withColumn("dataset", F.lit("klines"))
    chosen = preferred(dated.select("symbol", "dataset", "date").distinct()).select("symbol", "date")
    kept = dated.join(chosen, ["symbol", "date"], "left_semi").drop("dataset")
    at = F.when(F.col("open_time") > 10**14, F.timestamp_micros("open_time")).otherwise(F.timestamp_millis("open_time")).cast("timestamp_ntz")
    inside = kept.withColumn("open_ts", at).where((F.col("open_ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("open_ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")))
    return inside.dropDuplicates(["symbol", "open_ts"]).drop("date")


def parquet_bytes(rows: DataFrame, path: str) -> int:
    """Bytes of rows as zstd Parquet at ``path``, without an ``ignore`` column."""
    rows.drop("ignore").write.mode("errorifexists").option("compression", "zstd").parquet(path)
    files = rows.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def write_report(records: dict[str, DataFrame], path: str) -> None:
    """Reports as JSON lines, one folder for each name; timestamps as text, non-ASCII characters as they are."""
    for name, frame in records.items():
        frame.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(f"{path}/{name}")


def normalised(rows: DataFrame, symbol) -> DataFrame:
    """Rows as stored: UTC times, filler flag, no ``ignore`` column, partition columns."""
    at = F.when(F.col("open_time") > 10**14, F.timestamp_micros("open_time")).otherwise(F.timestamp_millis("open_time"))
    price = [F.col(c) for c in ("open", "high", "low", "close")]
    out = rows.drop("ignore").withColumn("symbol", symbol).withColumn("open_ts", at.cast("timestamp_ntz")).withColumn("is_filler", is_filler(*price, F.col("volume")))
    return out.withColumn("year", F.year("open_ts")).withColumn("month", F.month("open_ts"))


def write_normalised(rows: DataFrame, path: str) -> None:
    rows.repartition("symbol", "year", "month").sortWithinPartitions("open_ts").write.mode("append").option("compression", "zstd").partitionBy("symbol", "year", "month").parquet(path)


def pending(listing: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Objects that the manifest doesn't hold as verified."""
    return listing if manifest is None else listing.join(manifest.where("status = 'verified'").select("key"), "key", "left_anti")


def manifest_rows(zips: DataFrame) -> DataFrame:
    return zips.select("key", "sha256", F.octet_length("content").cast("long").alias("bytes"), F.when(F.col("sha256_ok"), "verified").otherwise("rejected").alias("status"))


def preferred(listing: DataFrame) -> DataFrame:
    """Monthly objects, and daily ones of months that their symbol and dataset have no monthly object of;
    listing(symbol, dataset, date, ...)."""
    months = listing.where(F.length("date") == 7).select(F.col("symbol").alias("_symbol"), F.col("dataset").alias("_dataset"), F.col("date").alias("_month")).distinct()
    same = (F.col("symbol") == F.col("_symbol")) & (F.col("dataset") == F.col("_dataset")) & (F.substring("date", 1, 7) == F.col("_month"))
    return listing.join(months, (F.length("date") == 10) & same, "left_anti")
