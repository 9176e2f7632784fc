"""Mixing the documents of several sources to target weights, by weighted fair queueing.

Every source sends its documents in a shuffled order, again and again up to ``repeats`` times.  A document leaves at a
virtual finish time: the tokens that its source has sent by then, divided by the source's target.  The mix is all of
these in order of virtual time, cut where the budget is spent; at the time 1 every source has sent its target.

Only DataFrame functions are used.  Running token counts come from ranges of the shuffled order within a source, so
that a source that holds most rows is spread over many tasks, and the cut is found from the sums of ranges of virtual
time: only the range in which it falls is sorted to find it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import cut

_WORDS = r"[^\x20\x09-\x0D]+"
#: Ranges, at least, of the order within a source and of one unit of virtual time; more with more shuffle partitions.
RANGES = 64


def _ranges(frame: DataFrame) -> int:
    return max(RANGES, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """(source, number, source_size, target) of sizes(source, size).

    Sources in order of their names, null last, have the weights in turn and share so much of all tokens by them; a
    target stops at ``repeats`` times the source's size, and what is left over is shared anew by weight among the others,
    until none is above.  A round is one sum over the sources."""
    from tidemark.operators.stats import ordered

    sums = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("unnamed", F.col("source").isNull()), "sources", 10_000)
    table = F.array(*(F.lit(float(w)) for w in weights))
    weighted = ordered(sums, "unnamed", ["source"]).withColumn("weight", F.get(table, (F.col("place") % len(weights)).cast("int")))
    rows = cut(weighted.select("source", F.col("place").alias("number"), "source_size", "weight", (repeats * F.col("source_size")).alias("most")), "weights", 10_000)
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, -1  # tokens for each unit of weight, and how many sources stop at their most
    while True:
        stops = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("most")
        at = rows.agg(F.count_if(stops).alias("full"), F.sum(F.when(stops, F.col("most")).otherwise(0)).alias("spent"), F.sum(F.when(stops, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if at["full"] == full or not at["weight"]:
            break
        full, level = at["full"], float(total * share - at["spent"]) / at["weight"]
    target = F.lit(0.0) if level is None else F.least(F.col("weight") * F.lit(level), F.col("most").cast("double"))
    return rows.select("source", "number", "source_size", target.alias("target"))


def queued(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, repeats: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rows, stop): documents(doc_id, text, source, ...) as rows(doc_id, source, size, source_size, target, number, sent,
    place), and the row at which the mix stops.

    ``sent`` is how many tokens its source has sent once the document has left for the first time.  The order within a
    source is that of MD5 digests of id and text, the same in every run; rows that are equal in all three are as good as
    each other.  A null text has no tokens; a null source is a source of its own; a null doc_id is as good as any."""
    ranges = _ranges(documents)
    text = F.coalesce("text", F.lit(""))
    place = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    sizes = documents.select("doc_id", "source", F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("size"), place.alias("place"))
    stretch = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * ranges / (1 << 32))
    sizes = cut(sizes.withColumn("stretch", stretch), "sizes", 10_000)
    targets = cut(source_targets(sizes, weights, share, repeats), "targets", 10_000)
    sums = sizes.groupBy("source", "stretch").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    bases = sums.select(F.col("source").alias("s"), F.col("stretch").alias("r"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    bases = bases.join(targets.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t"))).drop("t")
    own = Window.partitionBy("source", "stretch").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, 0)
    running = sizes.withColumn("here", F.sum("size").over(own))
    rows = running.join(bases, running["source"].eqNullSafe(bases["s"]) & (running["stretch"] == bases["r"])).withColumn("sent", F.col("base") + F.col("here"))
    rows = cut(rows.select("doc_id", "source", "size", "source_size", "target", "number", "sent", "place"), "queue", 10_000)
    return rows, _stop(rows, share, repeats, ranges)


def _finish(turn):
    """The virtual time at which a document has left ``turn`` times before and once more; null for a target of nothing."""
    return F.try_divide((turn * F.col("source_size") + F.col("sent")).cast("double"), F.col("target"))


def _range(finish, ranges: int):
    """Ranges of virtual time, which get longer with time, so that they are few however late the last document leaves."""
    return F.floor(F.log2(1 + finish) * ranges)


def _paid(finish, ranges: int):
    """Whether a sending is in the mix; of rows that are joined to the one row of ``_stop``."""
    same = (_range(finish, ranges) == F.col("stop_range")) & F.col("stop_finish").isNotNull()
    before = (finish < F.col("stop_finish")) | (finish == F.col("stop_finish")) & (F.col("number") <= F.col("stop_number"))
    return F.col("stop_range").isNull() | (_range(finish, ranges) < F.col("stop_range")) | same & before


def _sendings(rows: DataFrame, repeats: int, ranges: int) -> DataFrame:
    """A row for each time that a document with tokens may be sent: ``turn`` from 0, its ``finish`` and the range of that."""
    turns = rows.where("size > 0 AND target > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return turns.withColumn("finish", _finish(F.col("turn"))).withColumn("range", _range(F.col("finish"), ranges))


def _stop(rows: DataFrame, share: float, repeats: int, ranges: int) -> DataFrame:
    """(stop_range, stop_finish, stop_number), one row: sendings up to it, in order of (finish, number), are all that the
    budget pays for.  No range, and all are; no finish, and none of that range is."""
    budget = rows.agg((F.coalesce(F.sum("size"), F.lit(0)) * F.lit(share)).alias("budget"))  # one row
    sent = _sendings(rows, repeats, ranges)
    totals = sent.groupBy("range").agg(F.sum("size").alias("total"))
    running = totals.withColumn("after", F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)))  # one row a range
    last = running.join(F.broadcast(budget)).where(F.col("after") > F.col("budget")).agg(F.min_by(F.struct("range", (F.col("budget") - F.col("after") + F.col("total")).alias("left")), "range").alias("at"))
    last = cut(last.select("at.range", "at.left"), "range", 10_000)
    inside = sent.join(F.broadcast(last), "range").withColumn("spent", F.sum("size").over(Window.partitionBy("range").orderBy("finish", "number").rowsBetween(Window.unboundedPreceding, 0)))
    at = inside.where(F.col("spent") <= F.col("left")).agg(F.max(F.struct("finish", "number")).alias("at"))
    return cut(last.join(at, how="left").select(F.col("range").alias("stop_range"), F.col("at.finish").alias("stop_finish"), F.col("at.number").alias("stop_number")), "stop", 10_000)


def mixed(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, repeats: int = 3) -> DataFrame:
    """The mix itself: (doc_id, source, number, turn, finish, start, size) of every sending, with the tokens of the mix
    before it as ``start``, by which it is ordered.

    Nothing but whole documents is sent, so the mix holds at most the budget; documents without tokens aren't sent."""
    rows, stop = queued(documents, weights, share, repeats)
    sent = _sendings(rows, repeats, ranges := _ranges(documents)).join(F.broadcast(stop)).where(_paid(F.col("finish"), ranges))
    sums = sent.groupBy("range").agg(F.sum("size").alias("total"))
    bases = sums.select("range", F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row a range
    before = Window.partitionBy("range").orderBy("finish", "number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("size").over(before), F.lit(0))
    return sent.join(bases, "range").select("doc_id", "source", "number", "turn", "finish", start.alias("start"), "size")


def mix_shares(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, repeats: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of documents: how many tokens the mix takes of it, repeats
    counted.  No rows give none; further columns of documents, whatever their names, are not looked at."""
    rows, stop = queued(documents, weights, share, repeats)
    ranges = _ranges(documents)
    times = F.lit(0)
    for turn in range(repeats):
        times = times + F.when((F.col("target") > 0) & _paid(_finish(turn), ranges), 1).otherwise(0)
    return rows.join(F.broadcast(stop)).select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"))
