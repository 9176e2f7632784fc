"""URL filters by a sort-merge range join.

A host is written from its last label to its first, each label followed by a dot: a rule's host and all of its
subdomains are then one interval of keys, the ones that begin with the rule's key.  Keys are dealt out by
range, rules to every range that their interval meets; each range is sorted and swept once, with a stack of
the rules whose intervals are open, which always nest.  Of the open rules whose path fits, the longest wins.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys sampled for each range, to find the ranges' limits.
SAMPLED_KEYS = 32


def url_parts(url) -> tuple[F.Column, F.Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; then up to ``?``,
    ``#`` or the end.  Null or without ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)


def canonical_key(host) -> F.Column:
    """com.example.www. for www.example.com; empty for no host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _deal(limits: list[tuple[str, int]]):
    """The range of each URL; for rules, a row for each range that their interval meets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first = np.array([bisect_right(limits, (k, t)) for k, t in zip(batch["key"], batch["tie"])], np.int64)
            rule = batch["kind"].to_numpy() == 0
            last = first.copy()
            for i in np.flatnonzero(rule):
                key = batch["key"].iat[i]
                first[i] = bisect_right(limits, (key, -(1 << 63)))
                last[i] = bisect_right(limits, (key + "\U0010ffff", 0))
            row = np.repeat(np.arange(len(batch)), last - first + 1)
            part = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
            yield batch.iloc[row].assign(part=part.astype(np.int32))

    return run


def _sweep(default: str):
    """Rows sorted by range, key and kind (rules first).  The stack holds, for each open key, its rules by path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, stack = None, []
        for batch in batches:
            rules, verdicts = [], []
            for here, key, kind, host, path, action in zip(*(batch[c] for c in ("part", "key", "kind", "host", "path", "action"))):
                if here != part:
                    part, stack = here, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, set()))
                    _, _, paths, sizes = stack[-1]
                    paths[path] = min(action, paths.get(path, action))
                    sizes.add(len(path))
                    continue
                best, verdict = None, default
                for _, rule_host, paths, sizes in reversed(stack):
                    fits = max((n for n in sizes if n <= len(path) and path[:n] in paths), default=None)
                    if fits is not None and (best is None or len(rule_host) + fits > len(best)):
                        best, verdict = rule_host + path[:fits], paths[path[:fits]]
                rules.append(best)
                verdicts.append(verdict)
            yield batch[batch["kind"] == 1][["page_id", "host", "path"]].assign(rule=rules, verdict=verdicts)

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages(page_id, url) under rules(host, path, action).

    A rule fits its host and all subdomains where the URL's path begins with the rule's; the longest host and
    path together wins, of equal ones that of the longer host; of rules given twice the least action.  A rule
    without a host fits every URL.  rule is host and path as written, null where none fits, and the verdict
    is then ``default``.  Rules with a null are left out, null paths count as empty.  URLs may repeat, be null
    or malformed (host and path are then empty); no rules or no pages give the obvious results.
    """
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", canonical_key(F.col("host")))
    # One URL may be a third of all rows: a hash of the page tells its rows apart
    urls = urls.withColumn("tie", F.xxhash64("page_id", "path"))
    spark = pages.sparkSession
    # As many ranges as the session deals shuffled rows to; a range is sorted with spilling and streamed
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = urls.select("key", "tie").orderBy(F.xxhash64("tie", F.lit(17)), "tie", "key").limit(SAMPLED_KEYS * parts)
    ranked = sample.select("key", "tie", F.row_number().over(Window.orderBy("key", "tie")).alias("at"), F.count("*").over(Window.partitionBy()).alias("n"))  # SAMPLED_KEYS * parts rows at most
    size = F.greatest(F.lit(1), F.floor(F.col("n") / parts))
    limits = sorted((r.key, r.tie) for r in ranked.where((F.col("at") > 1) & ((F.col("at") - 1) % size == 0)).select("key", "tie").collect())  # one a range
    kind = pages.schema["page_id"].dataType
    opened = rules.where("host is not null and action is not null").select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    opened = opened.select(F.lit(0).cast("byte").alias("kind"), canonical_key(F.col("host")).alias("key"), F.lit(0).cast("long").alias("tie"), F.lit(None).cast("string").alias("page_id"), "host", "path", "action")
    events = urls.select(F.lit(1).cast("byte").alias("kind"), "key", "tie", F.col("page_id").cast("string").alias("page_id"), "host", "path", F.lit(None).cast("string").alias("action")).unionByName(opened)
    schema = "kind byte, key string, tie long, page_id string, host string, path string, action string, part int"
    dealt = events.mapInPandas(_deal(limits), schema).repartitionById(len(limits) + 1, F.col("part")).sortWithinPartitions("part", "key", "kind")
    judged = dealt.mapInPandas(_sweep(default), "page_id string, host string, path string, rule string, verdict string")
    return judged.withColumn("page_id", F.col("page_id").cast(kind))
