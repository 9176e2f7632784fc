"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A longer text doesn't train.
LONGEST = 1_000_000


def remainder(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5; 0 where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def held_out(doc_id) -> F.Column:
    """Rows that no training sees: those of remainder 0."""
    return remainder(doc_id) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int, chars: int) -> list:
    """Rows (text, label, fold) for training: of each label the first ``rows`` ids by a hash, then whole texts
    until ``chars`` characters are used.  Held-out ids, labels other than 0 and 1, null texts and texts over
    LONGEST characters don't train; equal texts train once.  fold is the id's remainder, 1 to 4."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where(~held_out(F.col("doc_id")) & F.col("label").isin(0, 1))
    chosen = [ids.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= LONGEST)
    texts = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")  # 2 * rows at most
    texts = texts.select("text", "label", remainder(F.col("doc_id")).alias("fold"), F.length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(4 * rows)
    seen, out = set(), []
    for row in texts.toLocalIterator():
        if row.text not in seen and row.n <= chars:
            seen.add(row.text)
            chars -= row.n
            out.append(row)
    return out
