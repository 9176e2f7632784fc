"""Token files: flat unsigned integers, 64-bit document offsets, and bases from prefix sums.

A shard is three files: ``.tokens`` (ids of its documents, one after another), ``.offsets`` (64-bit index of
each document's first id, and the total at the end) and ``.docs`` (64-bit doc_ids and a flag for null).
Shards follow each other in ascending doc_id; the manifest names them, and the prefix sums of its counts
are the shards' bases.  A task that is run again writes shards of new names, and only those that the
manifest names count.
"""

from __future__ import annotations

import os
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.shared import cut, new_path

#: A shard ends with the document that brings it to so many ids or documents; a task holds its documents' offsets.
SHARD_TOKENS, SHARD_DOCS = 1 << 26, 1 << 20
#: Texts of characters below this one are cut into pieces here; others are left to the library as a whole.
FAST_BELOW = 0x250
#: Pieces that a worker remembers before it starts anew.
MEMO = 1 << 20


def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other: as in the piece pattern of the vocabulary."""
    out = np.full(FAST_BELOW, 3, np.uint8)
    for c in range(FAST_BELOW):
        kind = unicodedata.category(chr(c))[0]
        if c in (*range(9, 14), 0x20, 0x85, 0xA0):
            out[c] = 0
        elif kind in "LN":
            out[c] = "LN".index(kind) + 1
    return out


def _plain(text: str) -> bool:
    """Whether all characters are below FAST_BELOW."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return max(text) < chr(FAST_BELOW)
    return True


class WordTokenizer:
    """Ids of whole texts as the tokenizers library gives them, each distinct piece encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.classes = _classes()
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.count, self.size = 0, 0
        self.begin, self.length, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and each one's number of ids.

        One text holds all pieces: a piece's last token, and no other, ends a word."""
        ids = np.array(self._library([" ".join(texts)])[0], np.uint32)
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) == len(texts) and last[-1] == len(ids):
            return ids, np.diff(last, prepend=0)
        each = self._library(texts)
        return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)

    def _remember(self, keys: list[int], texts: list[str]) -> None:
        if not keys:
            return
        ids, length = self._pieces(texts)
        here, there = self.count + len(keys), self.size + len(ids)
        if here > len(self.begin):
            self.begin, self.length = np.resize(self.begin, 2 * here), np.resize(self.length, 2 * here)
        if there > len(self.flat):
            self.flat = np.resize(self.flat, 2 * there)
        self.begin[self.count : here], self.length[self.count : here] = self.size + np.cumsum(length) - length, length
        self.flat[self.size : there] = ids
        self.slots.update(zip(keys, range(self.count, here)))
        self.count, self.size = here, there

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text of a block."""
        lowered = [(text or "").lower() for text in texts]
        plain = [i for i, text in enumerate(lowered) if _plain(text)]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        rest = sorted({*range(len(texts))} - {*plain})
        for i, ids in zip(rest, self._library([texts[i] for i in rest])):
            out[i] = np.array(ids, np.uint32)
        if not plain:
            return out
        joined = "\n".join([*(lowered[i] for i in plain), ""])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = np.zeros(len(codes) + 4, np.uint8)
        kind[1:-3] = self.classes[codes]
        here, before = kind[1:-3], kind[:-4]
        start = np.zeros(len(codes) + 4, bool)
        start[: len(codes)] = (here > 0) & ((here != before) | (here == 2))
        quote = np.flatnonzero((codes == 0x27) & (before != 3))
        if len(quote):  # 's 't 'm 'd 're 've 'll are pieces
            wide = np.append(codes, [10, 10, 10])
            one, two = wide[quote + 1], wide[quote + 2]
            length = np.where(np.isin(one, [115, 116, 109, 100]), 2, 0)
            length[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)] = 3
            quote, length = quote[length > 0], length[length > 0]
            start[quote + 1] = False
            after = quote + length
            start[after] |= kind[after + 1] > 0
        start = start[: len(codes) + 1]
        at = np.flatnonzero(start)
        stop = np.flatnonzero((here > 0) & (start[1:] | (kind[2:-2] == 0))) + 1
        keys = K.SpanHash(codes)(at, stop)
        distinct, index, inverse = K.distinct(keys)
        if self.count > MEMO:
            self._forget()
        listed = distinct.tolist()
        new = [j for j, key in enumerate(listed) if key not in self.slots]
        self._remember([listed[j] for j in new], [joined[at[index[j]] : stop[index[j]]] for j in new])
        slot = np.fromiter(map(self.slots.__getitem__, listed), np.int64, len(listed))[inverse]
        length, begin = self.length[slot], self.begin[slot]
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(begin - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.cumsum([len(lowered[i]) + 1 for i in plain])
        last = np.searchsorted(at, edges)
        bounds = np.concatenate([[0], ends])[last]
        for i, part in zip(plain, np.split(ids, bounds[:-1])):
            out[i] = part
        return out


class _Shard:
    def __init__(self, directory: str, sequence: int):
        self.sequence, self.name = sequence, f"{directory}/shard-{uuid.uuid4().hex}"
        self.files, self.path = fs.FileSystem.from_uri(self.name)
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.tokens = self.files.open_output_stream(self.path + ".tokens")
        self.offsets, self.docs, self.nulls, self.total = [0], [], [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.tokens.write(ids.tobytes())
        self.total += len(ids)
        self.offsets.append(self.total)
        self.docs.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)

    def close(self) -> dict:
        self.tokens.close()
        with self.files.open_output_stream(self.path + ".offsets") as out:
            out.write(np.array(self.offsets, "<i8").tobytes())
        with self.files.open_output_stream(self.path + ".docs") as out:
            out.write(np.array(self.docs, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes())
        return {"partition": [TaskContext.get().partitionId()], "sequence": [self.sequence], "shard": [self.name], "n_docs": [len(self.docs)], "n_tokens": [self.total]}


def _write(path: str, end_id: int, directory: str, width: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, shard, sequence = WordTokenizer(path), None, 0
        for batch in batches:
            texts, ids = batch["text"].tolist(), [None if x is None else int(x) for x in batch["doc_id"]]
            for a, z in K.blocks(texts):
                for doc_id, tokens in zip(ids[a:z], encode(texts[a:z])):
                    shard = shard or _Shard(directory, sequence)
                    shard.add(doc_id, np.append(tokens, end_id).astype(width))
                    if shard.total >= SHARD_TOKENS or len(shard.docs) >= SHARD_DOCS:
                        yield pd.DataFrame(shard.close())
                        shard, sequence = None, sequence + 1
        if shard:
            yield pd.DataFrame(shard.close())

    return run


def write_token_files(docs: DataFrame, path: str, end_id: int, vocabulary: int = 1 << 16, directory: str | None = None) -> DataFrame:
    """Write docs(doc_id, text) as token files and return the manifest: (shard, n_docs, n_tokens, base, width).

    ``path``: a tokenizers file; ``end_id`` follows every document.  Documents are in ascending doc_id, null
    first, rows of one doc_id by a hash of their text and then by text.  Null and empty texts hold the end
    id alone.  An empty table gives an empty manifest.  Other columns are ignored.  ``width`` is the
    smallest unsigned type for ids below ``vocabulary``.
    """
    spark = docs.sparkSession
    width = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    ordered = docs.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # as text: beside nulls, pandas has no integers
    shards = ordered.mapInPandas(_write(path, end_id, directory or new_path(spark, "tokens"), width), "partition int, sequence int, shard string, n_docs long, n_tokens long")
    order = Window.orderBy("partition", "sequence").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return cut(shards, "shards").select("shard", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).cast("long").alias("base"), F.lit(width).alias("width"))


def _map(name: str) -> np.ndarray:
    """A file's bytes, memory-mapped where it is on a mounted disk."""
    files, path = fs.FileSystem.from_uri(name)
    if files.get_file_info(path).size == 0:
        return np.zeros(0, np.uint8)
    if files.type_name == "local":
        return np.memmap(path, np.uint8, "r")
    with files.open_input_file(path) as stream:
        return np.frombuffer(stream.read_buffer(), np.uint8)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for shard, base, width in zip(batch["shard"], batch["base"], batch["width"]):
            tokens, offsets = _map(shard + ".tokens").view(width), _map(shard + ".offsets").view("<i8")
            docs, n = _map(shard + ".docs"), len(offsets) - 1
            names, nulls = docs[: 8 * n].view("<i8"), docs[8 * n :]
            done = 0
            while done < n:
                stop = max(done + 1, int(np.searchsorted(offsets, offsets[done] + K.BLOCK_BYTES, "right")) - 1)
                span = range(done, min(stop, n))
                ids = pd.array(names[span.start : span.stop].tolist(), "Int64")
                ids[np.flatnonzero(nulls[span.start : span.stop])] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "start": base + offsets[span.start : span.stop], "n_tokens": np.diff(offsets[span.start : span.stop + 1]), "ids": [tokens[offsets[i] : offsets[i + 1]].astype("<u4").tobytes() for i in span]})
                done = span.stop


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the manifest's shards; start counts the ids of all
    documents before it, and ids are little-endian unsigned 32-bit integers."""
    shards = max(1, manifest.count())  # a number of its own: rows are small, and Spark would put them all in one task
    return manifest.repartition(shards, "shard").mapInPandas(_read, "doc_id long, start long, n_tokens long, ids binary")
