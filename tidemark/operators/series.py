"""Ordered rows of few, large keys.

A window over a whole symbol would put a fifth of all rows in one task.  Here rows get their index within
the symbol from counts by (symbol, stretch of time) and a prefix sum over these few counts; bounded frames
then run on chunks of the index that also hold the rows just before and after them, and unbounded ones on
chunks whose carried values come from a window over one row for each chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a chunk, and days of a stretch.
CHUNK, STRETCH_DAYS = 4096, 7


def indexed(frame: DataFrame, key: str = "symbol", t: str = "t", tie: list[str] | None = None, stretch: Column | None = None) -> DataFrame:
    """frame with ``idx``, the row's place within its key by (t, tie), from 0.

    ``stretch``: the stretch of a row, which mustn't fall as (t, tie) rises; weeks of t unless given."""
    weeks = F.floor(F.unix_seconds(F.col(t).cast("timestamp")) / (86_400 * STRETCH_DAYS)) if stretch is None else stretch
    rows = frame.withColumn("_stretch", weeks)
    counts = rows.groupBy(key, "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    base = counts.select(key, "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy(key, "_stretch").orderBy(t, *(tie or []))
    return rows.withColumn("_at", F.row_number().over(own)).join(base, [key, "_stretch"]).withColumn("idx", F.col("_base") + F.col("_at") - 1).drop("_stretch", "_at", "_base")


def chunked(rows: DataFrame, before: int, after: int = 0, key: str = "symbol") -> tuple[DataFrame, Window]:
    """Indexed rows dealt to chunks, each with copies of the ``before`` rows before and ``after`` rows behind it.

    Returns the rows, marked ``_halo`` where they are copies, and the window to use; see ``own``."""
    if max(before, after) > CHUNK:
        raise ValueError("frames may not be longer than a chunk")
    here, place = F.floor(F.col("idx") / CHUNK), F.col("idx") % CHUNK
    copies = F.array(F.struct(here.alias("c"), F.lit(False).alias("h")), F.when(place >= CHUNK - before, F.struct((here + 1).alias("c"), F.lit(True).alias("h"))), F.when(place < after, F.struct((here - 1).alias("c"), F.lit(True).alias("h"))))
    dealt = rows.withColumn("_copy", F.explode(F.array_compact(copies))).withColumn("_chunk", F.col("_copy.c")).withColumn("_halo", F.col("_copy.h")).drop("_copy")
    return dealt, Window.partitionBy(key, "_chunk").orderBy("idx")


def own(rows: DataFrame) -> DataFrame:
    return rows.where("NOT _halo").drop("_halo", "_chunk", "idx")


def windowed(frame: DataFrame, columns, before: int, after: int = 0, key: str = "symbol", t: str = "t", stretch: Column | None = None) -> DataFrame:
    """frame with further columns, each a function of the ordered window, of frames of ``before`` rows at most
    before the current one and ``after`` rows behind it."""
    dealt, window = chunked(indexed(frame, key, t, stretch=stretch), before, after, key)
    return own(dealt.withColumns({name: make(window) for name, make in columns.items()}))


def carried(frame: DataFrame, value: Column, name: str, order: list[str], key: str = "symbol", t: str = "t") -> DataFrame:
    """frame with the last non-null ``value`` up to and including each row, by (t, order), as ``name``."""
    rows = indexed(frame.withColumn("_value", value), key, t, order).withColumn("_chunk", F.floor(F.col("idx") / CHUNK))
    last = rows.groupBy(key, "_chunk").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("idx"))).alias("_last"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    entry = last.select(key, "_chunk", F.last("_last", ignorenulls=True).over(before).alias("_entry"))
    here = Window.partitionBy(key, "_chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_here", F.last("_value", ignorenulls=True).over(here)).join(entry, [key, "_chunk"])
    return out.withColumn(name, F.coalesce("_here", "_entry")).drop("_value", "_chunk", "_here", "_entry", "idx")


def accumulated(frame: DataFrame, value: str, name: str, how, order: list[str], key: str = "symbol", t: str = "t", inclusive: bool = True) -> DataFrame:
    """frame with the running ``how`` (F.sum, F.max or F.min) of ``value`` by (t, order); not inclusive: of the
    rows before alone."""
    rows = indexed(frame, key, t, order).withColumn("_chunk", F.floor(F.col("idx") / CHUNK))
    totals = rows.groupBy(key, "_chunk").agg(how(value).alias("_total"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    entry = totals.select(key, "_chunk", how("_total").over(before).alias("_entry"))
    here = Window.partitionBy(key, "_chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = rows.withColumn("_here", how(value).over(here)).join(entry, [key, "_chunk"])
    both = {"sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": F.greatest, "min": F.least}[how.__name__]
    return out.withColumn(name, both(F.col("_entry"), F.col("_here"))).drop("_chunk", "_here", "_entry", "idx")
