"""Names of archived objects, and predicates on price bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: the date before an archive's ending.
DATE = r"([0-9]{4}-[0-9]{2}(?:-[0-9]{2})?)\.zip$"


def date_of(key: Column) -> Column:
    """The date before ``.zip`` (YYYY-MM or YYYY-MM-DD); empty where there is none."""
    return F.regexp_extract(key, DATE, 1)


def in_window(date: Column, start: str, end: str) -> Column:
    """Whether a date of any precision lies between bounds cut to its length, inclusive; true for an empty one."""
    return (F.substring(F.lit(start), 1, F.length(date)) <= date) & (date <= F.substring(F.lit(end), 1, F.length(date)))


def number(x: Column) -> Column:
    """NaN as null, which comparisons then skip; Spark would order it above all numbers."""
    return F.when(~F.isnan(x), x)


def ohlc_violation(o: Column, h: Column, lo: Column, c: Column) -> Column:
    """High below open or close, low above either, or high below low; NaN and null are skipped."""
    o, h, lo, c = (number(x) for x in (o, h, lo, c))
    return F.coalesce(h < F.greatest(o, c), F.lit(False)) | F.coalesce(lo > F.least(o, c), F.lit(False)) | F.coalesce(h < lo, F.lit(False))


def negative_cells(*columns: Column) -> Column:
    return sum((F.coalesce(number(x) < 0, F.lit(False)).cast("long") for x in columns), F.lit(0).cast("long"))


def is_filler(o: Column, h: Column, lo: Column, c: Column, volume: Column) -> Column:
    return (volume == 0) & (o == h) & (h == lo) & (lo == c)


def epoch_unit(first: Column) -> Column:
    """Microseconds where the first value is above 10 ** 14, else milliseconds."""
    return F.when(first > 10**14, "us").otherwise("ms")
