"""Collocations of several words, by SETM relational mining.

The occurrence relation of length k holds, for each place of each piece of text, the phrase of k words that begins there,
sorted by piece and place and written to the shared folder.  It is merge-joined with itself at the next place, which
gives the occurrences of length k + 1; these are counted by group, and groups that are frequent are joined back by
semi-join before the next length, so that nothing else is extended.

A row of a relation is a block: the places of many pieces of one language, one after another, so that neighbours meet
inside a row and no occurrence is shuffled on its own.  What meets others in Spark are a block's distinct groups with
their counts, at most one for each block, however often a phrase occurs.  Groups that turn out to be frequent go back to
their blocks from where they were counted.

Blocks are dealt to parts of the relation.  The next length is made one part after another, and a part goes as soon as
that of the next length is written, so that two relations, or all that moves between them, are never on disk whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import BATCH_ROWS, cut, delete, new_path, setting, small_batches, tidy_shuffles

#: Places of a block, about: a longer document is a block of its own.  Blocks of a batch that goes to a Python worker.
BLOCK, BLOCK_BATCH = 1 << 19, 8
#: Bytes of a row group of blocks: readers hold a row group at once.
ROW_GROUP = 8 << 20
#: Passes in which groups are counted, each with its share of the phrases, and in which relations are extended, each with
#: its share of the blocks, so that so much less is in the shuffle at once.
PASSES = 3
#: Blocks are sorted by part before they are written, unless as many writers may be open at once.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Tasks among which the best phrases of one language are chosen first.
SALTS = 64
WORDS = "block long, lang string, words array<string>, n array<long>, places binary"
OCCURRENCES = "block long, lang string, first array<long>, rest array<long>, n array<long>, places binary"
_END = b"\xff"  # no byte of UTF-8
_LOWER = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _block(lang: str, number: int, tokens: list[bytes]) -> pd.DataFrame:
    codes, words = pd.factorize(np.array([_END, *tokens], dtype=object))
    block = (TaskContext.get().partitionId() << 32) + number
    return pd.DataFrame({"block": [block], "lang": [lang], "words": [[w.decode() for w in words[1:]]], "n": [np.bincount(codes)[1:]], "places": [codes.astype("<u4").tobytes()]})


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of words: 0 where a piece ends, else the word's place in ``words``, from 1."""
    open_blocks, held, number = {}, 0, 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            tokens = text.encode().translate(_LOWER).replace(_END, b" \xff ").split()
            held += len(tokens) + 1
            open_blocks.setdefault(lang, []).extend((*tokens, _END))
            while held > 4 * BLOCK or open_blocks and len(open_blocks.get(lang, ())) >= BLOCK:
                largest = max(open_blocks, key=lambda x: len(open_blocks[x]))
                held -= len(open_blocks[largest])
                yield _block(largest, number := number + 1, open_blocks.pop(largest))
    for lang, tokens in open_blocks.items():
        yield _block(lang, number := number + 1, tokens)


def _extended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of the next length: places of which this one and the next begin frequent phrases hold that pair."""
    for batch in batches:
        for block, lang, places, kept, ids in zip(batch["block"], batch["lang"], batch["places"], batch["kept"], batch["ids"]):
            local = np.frombuffer(places, "<u4")
            table = np.zeros(int(local.max(initial=0)) + 1, dtype=np.int64)
            table[kept] = ids
            at = table[local]
            both = np.flatnonzero((at[:-1] > 0) & (at[1:] > 0))
            distinct, rank = np.unique(at, return_inverse=True)
            pair, inverse, n = np.unique(rank[both] * len(distinct) + rank[both + 1], return_inverse=True, return_counts=True)
            following = np.zeros(len(local), dtype="<u4")
            following[both] = inverse + 1
            yield pd.DataFrame({"block": [block], "lang": [lang], "first": [distinct[pair // len(distinct)]], "rest": [distinct[pair % len(distinct)]], "n": [n], "places": [following.tobytes()]})


def _write(blocks: DataFrame, path: str, batch: int) -> None:
    """Blocks of a relation, added to it by part, in small row groups."""
    spark = blocks.sparkSession
    small_batches(spark, batch)
    try:
        with tidy_shuffles(spark), setting(spark, _WRITERS, PASSES):
            dealt = blocks.withColumn("part", F.pmod("block", F.lit(PASSES)).cast("int"))
            dealt.write.mode("append").partitionBy("part").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        small_batches(spark)


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    return spark.read.schema(f"{schema}, part int").parquet(path)


def _extend(found: DataFrame, relation: str, held: DataFrame) -> tuple[DataFrame, str]:
    """The relation of the next length, from the groups that are held; and its path.  The relation before is deleted by parts."""
    spark, path = found.sparkSession, new_path(found.sparkSession, "occurrences")
    for part in range(PASSES):
        own = held.where(F.pmod("block", F.lit(PASSES)) == part)
        kept = own.groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("kept"))  # no more than a block's places
        kept = kept.select("block", F.col("kept.at").alias("kept"), F.col("kept.id").alias("ids"))
        rows = found.where(F.col("part") == part).select("block", "lang", "places").join(kept, "block")
        _write(rows.mapInPandas(_extended, OCCURRENCES), path, BLOCK_BATCH)
        delete(spark, f"{relation}/part={part}")
    delete(spark, relation)
    return _read(spark, OCCURRENCES, path), path


def _in_passes(groups: DataFrame, key: list[str], name: str, make: Callable[[DataFrame, int], DataFrame]) -> tuple[DataFrame, str]:
    """make(those groups whose key is of a pass, the pass) of all passes, written one after another; and its path."""
    spark, path = groups.sparkSession, new_path(groups.sparkSession, name)
    for part in range(PASSES):
        made = make(groups.where(F.pmod(F.xxhash64(*key), F.lit(PASSES)) == part), part)
        with tidy_shuffles(spark):
            made.write.mode("append").parquet(path)
    return spark.read.schema(made.schema).parquet(path), path


def _held(groups: DataFrame, key: list[str], least: int) -> tuple[DataFrame, str]:
    """(block, at, *key, a, row, id): groups of blocks whose phrase is frequent, with its count and a number of its own.
    One row of each phrase, and no other, has that number as ``row``.  A phrase has one group a block, so none is large."""
    same = Window.partitionBy(*key)

    def often(own: DataFrame, part: int) -> DataFrame:
        found = own.withColumn("a", F.sum("n").over(same)).where(F.col("a") >= least).drop("n")
        return found.withColumn("row", F.monotonically_increasing_id() * PASSES + part + 1).withColumn("id", F.min("row").over(same))

    return _in_passes(groups, key, "groups", often)


def frequent_phrases(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """(words by language, frequent phrases of each length from 1 to ``longest``).

    The first is (lang, n); phrases are (id, lang, phrase, last, a, firsts, rests, first, rest): ids of the phrases without
    the last and without the first word, and the counts of all shorter phrases that it begins and ends with.  Groups
    are deleted as soon as the relation of the next length is written, and a relation's parts one by one before."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    _write(texts.mapInPandas(_words, WORDS), relation := new_path(spark, "words"), BATCH_ROWS)
    found = _read(spark, WORDS, relation)
    total = found.select("lang", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    total = cut(total, "totals")
    groups = found.select("block", "lang", F.posexplode(F.arrays_zip("words", "n")).alias("at", "g")).select("block", (F.col("at") + 1).alias("at"), "lang", F.col("g.words").alias("phrase"), "g.n")
    none = F.array().cast("array<bigint>")
    held, spare = _held(groups, ["lang", "phrase"], least)
    one = held.where("row = id").select("id", "lang", "phrase", F.col("phrase").alias("last"), "a", none.alias("firsts"), none.alias("rests"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("rest"))
    levels = [cut(one, "frequent", 10_000)]
    for length in range(2, longest + 1):
        found, relation = _extend(found, relation, held)
        delete(spark, spare)
        groups = found.select("block", F.posexplode(F.arrays_zip("first", "rest", "n")).alias("at", "g")).select("block", (F.col("at") + 1).alias("at"), "g.first", "g.rest", "g.n")
        if length < longest:
            held, spare = _held(groups, ["first", "rest"], least)
            counted = held.where("row = id").select("id", "first", "rest", "a")
        else:  # nothing is extended further
            sums = lambda own, _: own.groupBy("first", "rest").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
            counted, spare = _in_passes(groups, ["first", "rest"], "counts", sums)
            counted = counted.withColumn("id", F.lit(None).cast("long"))
        before = levels[-1].select(F.col("id").alias("first"), "lang", F.col("phrase").alias("head"), F.array_append("firsts", F.col("a")).alias("firsts"))
        after = levels[-1].select(F.col("id").alias("rest"), "last", F.array_append("rests", F.col("a")).alias("rests"))
        both = counted.join(before, "first").join(after, "rest")
        levels.append(cut(both.select("id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a", "firsts", "rests", "first", "rest"), "frequent", 10_000))
    for path in (relation, spare):
        delete(spark, path)
    return total, levels


def phrase_collocations(docs: DataFrame, longest: int = 4, least: int = 30, percent: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language of docs(lang, text, ...).

    Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and those into words at spaces and tabs.
    Phrases are the contiguous runs of 2 to ``longest`` words in pieces that occur ``least`` times or more (a).  Where
    a phrase is cut in two, of which the parts occur l and r times, the score is 2,000,000 a / (l + r), rounded down; the
    cut that scores least counts, and of equal ones the first.  A phrase goes if a longer one that holds it occurs ``percent``
    percent as often, or more.  n counts all words of the language.  Equal scores and counts are ranked by phrase.

    A null lang is 'und', a null text empty; repeated rows count as often as they occur; no rows give none."""
    total, levels = frequent_phrases(docs, longest, least)
    candidates = None
    for i, level in enumerate(levels[1:], 1):
        rows = level
        if i + 1 < len(levels):  # the longer phrases that hold it are at most as frequent as those with one word more
            longer = levels[i + 1]
            most = longer.select(F.col("first").alias("id"), F.col("a").alias("_most")).unionByName(longer.select(F.col("rest").alias("id"), F.col("a").alias("_most"))).groupBy("id").agg(F.max("_most").alias("_most"))
            rows = level.join(most, "id", "left").where(F.col("_most").isNull() | (F.col("_most").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * percent))
        rows = rows.select("lang", "phrase", "a", "firsts", "rests")
        candidates = rows if candidates is None else candidates.unionByName(rows)
    # decimals: the product may pass 64 bits
    score = "(2000000 * cast(a AS decimal(20,0))) div (cast(firsts[k - 1] AS decimal(20,0)) + cast(rests[size(rests) - k] AS decimal(20,0)))"
    cuts = F.expr(f"array_min(transform(sequence(1, size(firsts)), k -> named_struct('score', {score}, 'k', k, 'l', firsts[k - 1], 'r', rests[size(rests) - k])))")
    scored = candidates.withColumn("cut", cuts).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    few = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_at") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)  # SALTS * top rows
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
