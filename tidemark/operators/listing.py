"""Datasets of archived objects: their names, listing documents, and coverage of a window by dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import date_of, in_window

# The markers of a listing document, the datasets and the prefixes of their objects.
KEY, TRUNCATED = "<Key>([^<]+)</Key>", "<IsTruncated>true</IsTruncated>"
DATASETS = {
    "klines_1m_monthly": ("data/futures/um/monthly/klines/%s/1m/", "1m"),
    "klines_1m_daily": ("data/futures/um/daily/klines/%s/1m/", "1m"),
    "metrics_daily": ("data/futures/um/daily/metrics/%s/", "metrics"),
    "fundingRate_monthly": ("data/futures/um/monthly/fundingRate/%s/", "fundingRate"),
}
#: Missing days that a coverage record names.
SAMPLE = 10


def prefixes(symbols: DataFrame) -> DataFrame:
    """(symbol, dataset, kind, prefix) of every symbol and dataset."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("dataset"), F.lit(kind).alias("kind"), F.lit(form).alias("form")) for name, (form, kind) in DATASETS.items())))
    return symbols.select("symbol", each.alias("d")).select("symbol", "d.dataset", "d.kind", F.replace("d.form", F.lit("%s"), "symbol").alias("prefix"))


def object_key(prefix: Column, symbol: Column, kind: Column, date: Column) -> Column:
    """The name of a dataset's object of a date."""
    return F.concat(prefix, symbol, F.lit("-"), kind, F.lit("-"), date, F.lit(".zip"))


def listed_keys(pages: DataFrame) -> DataFrame:
    """pages(..., document) as (..., key): the archives that listing documents name, checksum files left out."""
    found = pages.withColumn("key", F.explode(F.regexp_extract_all("document", F.lit(KEY), F.lit(1)))).drop("document")
    return found.where(F.col("key").endswith(".zip"))


def next_marker(document: Column) -> Column:
    """Where a listing goes on: the last name of a truncated document; null for the last document or one without names."""
    names = F.regexp_extract_all(document, F.lit(KEY), F.lit(1))
    return F.when(F.contains(document, F.lit(TRUNCATED)) & (F.size(names) > 0), F.element_at(names, -1))


def default_dates(today: Column, days: int) -> dict[str, Column]:
    """The window that ends yesterday, the last full month, and the day that is sampled."""
    end = F.date_sub(today, 1)
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    return {"start": iso(F.date_sub(end, days - 1)), "end": iso(end), "month": F.date_format(F.add_months(F.trunc(today, "MM"), -1), "yyyy-MM"), "sample_day": iso(F.date_sub(end, 2))}


def coverage_by_dataset(objects: DataFrame, wanted: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each (symbol, dataset) of ``wanted``: first and last date, objects, objects in the window, and
    for daily datasets the days expected, missing, and the first of these; objects(symbol, dataset, key).

    Objects without a date count as in the window, and sort first."""
    dated = objects.select("symbol", "dataset", date_of(F.col("key")).alias("date"))
    inside = in_window(F.col("date"), start, end)
    have = dated.groupBy("symbol", "dataset").agg(F.min("date").alias("first_available"), F.max("date").alias("last_available"), F.count("*").alias("files_total"), F.count_if(inside).alias("files_in_window"), F.collect_set(F.when(inside, F.col("date"))).alias("_have"))  # as many as the window has days
    days = F.transform(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")), lambda d: F.date_format(d, "yyyy-MM-dd"))
    missing = F.array_sort(F.array_except(days, F.coalesce("_have", F.array().cast("array<string>"))))
    daily = F.col("dataset").endswith("_daily")
    out = wanted.select("symbol", "dataset").join(have, ["symbol", "dataset"], "left")
    return out.select("symbol", "dataset", "first_available", "last_available", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("files_total", "files_in_window")),
                      F.when(daily, F.size(days).cast("long")).alias("days_expected"), F.when(daily, F.size(missing).cast("long")).alias("days_missing"), F.when(daily, F.array_join(F.slice(missing, 1, SAMPLE), ",")).alias("missing_sample"))
