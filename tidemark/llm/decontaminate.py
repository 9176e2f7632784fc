"""Benchmark decontamination by winnowing (Schleimer, Wilkerson, Aiken 2003).

Of each ``window - k + 1`` consecutive k-grams the one of least hash is a fingerprint, so two texts that
share ``window`` words share a fingerprint inside them.  Fingerprints of both sides are joined, and each
match is extended word by word within the ``window - k`` words on either side that travel with it: every
shared window holds a fingerprint, so all of its words are found.  Items shorter than ``window`` are
fingerprinted whole, at each length that occurs.

Before the join, document fingerprints pass a bitmap of the items' hash buckets.  Its size is fixed
(2 ** BUCKET_BITS flags); with many items it lets more through, and the join stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.shared import cut, through

BUCKET_BITS = 22
_SHIFT = np.uint64(64 - BUCKET_BITS)
_HIT = "array<struct<fp: long, pos: long, lead: int, context: string>>"


def winnow(words: K.Words, hashes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the fingerprints of a block; ties within a window all count."""
    grams, span = K.ngram_hashes(hashes, k), window - k + 1
    whole = K.within(words, window)
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = grams[: len(whole)].copy()
    for s in range(1, span):
        np.minimum(least, grams[s : s + len(whole)], out=least)
    chosen = np.zeros(len(grams), bool)
    for s in range(span):
        chosen[s : s + len(whole)] |= (grams[s : s + len(whole)] == least) & whole
    at = np.flatnonzero(chosen)
    return at, grams[at]


def whole_runs(words: K.Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of n words that lies in one text; n is part of the hash."""
    at = np.flatnonzero(K.within(words, n))
    return at, K.mix(K.ngram_hashes(hashes, n)[at] + np.uint64(n))


def _scan(k: int, window: int, lengths: list[int] | None, flags):
    """lengths: of short items that occur; None: the texts are items themselves.  flags: broadcast bitmap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["id"]
            for a, z in K.blocks(texts):
                words = K.Words(texts[a:z], K.ALNUM, True)
                hashes, counts = words.hashes(), words.counts()
                found = [(*winnow(words, hashes, k, window), 0)]
                for n in lengths if lengths is not None else np.unique(counts[(counts > 0) & (counts < window)]).tolist():
                    at, fp = whole_runs(words, hashes, n)
                    if lengths is None:
                        at, fp = (x[counts[words.doc[at]] == n] for x in (at, fp))
                    found.append((at, fp, n))
                hits: list[list] = [[] for _ in range(z - a)]
                for at, fp, n in found:
                    if flags is not None:
                        passed = flags.value[fp >> _SHIFT]
                        at, fp = at[passed], fp[passed]
                    for i, h in zip(at.tolist(), fp.view(np.int64).tolist()):
                        d = words.doc[i]
                        low, high = words.first[d], words.first[d + 1]
                        begin, end = (i, i + n) if n else (max(low, i - window + k), min(high, i + window))
                        hits[d].append({"fp": h, "pos": int(i - low), "lead": int(i - begin), "context": words.text(begin, end)})
                yield pd.DataFrame({"id": ids[a:z].array, "n_words": counts, "hits": hits})

    return run


def _extend(k: int, window: int):
    """Runs of at least ``window`` equal words around matching k-grams; a short item must match whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rid, pos, lead, context, item, item_lead, item_context, short in zip(*(batch[c] for c in ("rid", "pos", "lead", "context", "item_id", "item_lead", "item_context", "short"))):
                if short:
                    if context == item_context:
                        out.append((rid, item, pos, pos + short))
                    continue
                ours, theirs = context.split(" "), item_context.split(" ")
                if ours[lead : lead + k] != theirs[item_lead : item_lead + k]:
                    continue
                left = 0
                while left < min(lead, item_lead) and ours[lead - left - 1] == theirs[item_lead - left - 1]:
                    left += 1
                right, most = k, min(len(ours) - lead, len(theirs) - item_lead)
                while right < most and ours[lead + right] == theirs[item_lead + right]:
                    right += 1
                if left + right >= window:
                    out.append((rid, item, pos - left, pos + right))
            yield pd.DataFrame(out, columns=["rid", "item_id", "begin", "end"]).drop_duplicates()[["item_id", "rid", "begin", "end"]]

    return run


def benchmark_overlap(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs(doc_id, text)
    against items(item_id, text).

    Words are runs of ASCII letters (A-Z lowered), ASCII digits and characters beyond ASCII.  n_hit counts
    words inside any occurrence of ``window`` consecutive words of an item, or of a whole shorter item;
    n_items the distinct items with an occurrence.  items_sha256 is of their ids, sorted as strings and
    joined by commas.  Null and wordless texts have no words and no hits, and wordless items match nothing.
    Repeated rows are judged each for itself; a null doc_id stays null; a null item_id is matched but not
    counted among the items.  No items: nothing is contaminated.  No documents: no rows.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").alias("id"), F.col("text").cast("string").alias("text"))
    prints = cut(through(items, _scan(k, window, None, None), "id", f"n_words long, hits {_HIT}"), "items")
    lengths = [r[0] for r in prints.where(f"n_words between 1 and {window - 1}").select("n_words").distinct().collect()]  # fewer than window
    prints = prints.select(F.col("id").alias("item_id"), F.when(F.col("n_words") < window, F.col("n_words")).otherwise(0).cast("int").alias("short"), F.explode("hits").alias("h"))
    prints = prints.select("item_id", "short", F.col("h.fp").alias("fp"), F.col("h.lead").alias("item_lead"), F.col("h.context").alias("item_context")).distinct()
    flags = np.zeros(1 << BUCKET_BITS, bool)
    buckets = prints.select(F.shiftrightunsigned("fp", 64 - BUCKET_BITS).cast("int").alias("bucket")).distinct()  # 2 ** BUCKET_BITS at most
    flags[buckets.toPandas()["bucket"].to_numpy(np.int64)] = True
    docs = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    scanned = through(docs, _scan(k, window, lengths, spark.sparkContext.broadcast(flags)), "id", f"n_words long, hits {_HIT}")
    scanned = cut(scanned.withColumn("rid", F.monotonically_increasing_id()), "scanned")
    hits = scanned.select("rid", F.explode("hits").alias("h")).select("rid", "h.*").join(prints, "fp")
    runs = cut(through(hits, _extend(k, window), "item_id", "rid long, begin long, end long"), "runs")
    words = runs.select("rid", F.explode(F.sequence("begin", F.col("end") - 1)).alias("word")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    named = runs.groupBy("rid").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("found"))
    none = F.array().cast("array<string>")
    return (
        scanned.select("rid", F.col("id").alias("doc_id"), "n_words").join(words, "rid", "left").join(named, "rid", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(F.coalesce("found", none)).cast("long").alias("n_items"),
                F.sha2(F.concat_ws(",", F.coalesce("found", none)), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
    )
