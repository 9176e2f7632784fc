"""Byte-level BPE over overlapping chunks.

Every text is cut into chunks of ``chunk`` characters that each reach ``overlap`` characters into the next one.
Chunks are pre-tokenised each from its own first character.  As the pattern never looks behind, two runs of it that
have a boundary in common agree from there on; so a chunk takes over from the one before at their first common
boundary in the overlap, and the pieces that the chunks then own are encoded.  Where two chunks never
resynchronise (one run of letters, say), the run of the earlier one goes on through the later one.

Rows hold stretches of ``STRETCH`` chunks, each with one more chunk at either side, so that both neighbours see the
chunks around their common border and agree on it by themselves: stretches of one text are encoded in any task, and
only their ids are brought together.  A text of which two chunks at such a border never resynchronise is encoded as
one stretch instead.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, small_batches, through

#: Characters of a chunk and of what it shares with the next one; an ordinary document has several chunks.
CHUNK, OVERLAP = 1024, 128
#: Chunks of a row.
STRETCH = 256
#: The longest look-ahead of the pattern, in characters: boundaries that near to a chunk's end aren't trusted.
LOOK_AHEAD = 4
#: Pieces that a worker remembers before it starts anew, and the longest of them.
MEMO, MEMO_LONGEST = 1 << 16, 32
_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a file of ranks, without special tokens; kept by each worker."""
    if (path, pattern) not in _encodings:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


class _Pieces(dict):
    """Ids of a piece as little-endian unsigned 32-bit integers; remembers the short ones."""

    def __init__(self, codec: tiktoken.Encoding):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.codec._encode_single_piece(piece), "<u4").tobytes()
        if len(piece) <= MEMO_LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


def pretokens(text: str, begin: int, stop: int, split: regex.Pattern) -> list[int]:
    """Where the pieces of a run of the pattern begin, that starts at ``begin`` and sees the text up to ``stop``."""
    return [m.start() for m in split.finditer(text, begin, stop)]


def boundaries(text: str, chunk: int, overlap: int, split: regex.Pattern, first: int = 0) -> tuple[list[int], dict[int, int | None]]:
    """(positions where the pieces of ``text`` begin, for each chunk's start its first common boundary).

    Chunks start at ``first`` and every ``chunk`` characters from there; at 0 there is one more if ``first`` isn't 0.
    The common boundary is None where the chunks don't resynchronise.
    """
    starts = [*([0] if first else []), *range(first, max(len(text), first + 1), chunk), len(text)]
    found: list[int] = []
    joints: dict[int, int | None] = {}
    i, span = 0, 1
    while i < len(starts) - 1:
        start, common = starts[i], 0
        if i:
            # the last characters that the chunk before saw aren't sure, unless they end the text
            sure = stop if stop == len(text) else stop - LOOK_AHEAD
            while found and found[-1] > sure:
                found.pop()
            tail = {x for x in found[bisect_left(found, start) :]}
            run = pretokens(text, start, min(len(text), starts[i + 1] + overlap), split)
            joints[start] = common = next((x for x in run if x in tail), None)
            span = 2 * span if common is None else 1  # far runs of one piece are read a few times at most
        stop = min(len(text), starts[min(i + span, len(starts) - 1)] + overlap)
        if not i or common is None:
            common = found[-1] if found else 0
            run = pretokens(text, common, stop, split)
        while found and found[-1] >= common:
            found.pop()
        found += [x for x in run if x >= common]
        i += span
    return found, joints


def _encode(path: str, pattern: str, chunk: int, overlap: int):
    """Ids of the part of each row's text from ``begin`` on that belongs to it, and whether its borders were found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, split = _Pieces(encoding(path, pattern)), regex.compile(pattern)
        for batch in batches:
            out, lost = [], []
            for text, first, last in zip(batch.pop("text"), batch.pop("first"), batch.pop("last")):
                text = text or ""
                found, joints = boundaries(text, chunk, overlap, split, first)
                begin = joints.get(first) if first else 0
                # the next stretch only knows the last chunk's own run, which must be the one that counts here
                end = len(text) if last >= len(text) else joints.get(last) if joints.get(last - chunk) is not None else None
                lost.append(begin is None or end is None)
                if lost[-1]:
                    out.append(b"")
                    continue
                own = [x for x in found if begin <= x < end]
                out.append(b"".join([pieces[text[a:z]] for a, z in zip(own, [*own[1:], end])]))
            yield batch.assign(ids=out, lost=lost)

    return run


def _chained(first, second):
    """Both functions in one worker, batch by batch."""
    return lambda batches: second(first(batches))


def _join_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [b"".join(x["ids"] for x in parts) for parts in batch["parts"]]})


def byte_bpe_encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, stretch: int = STRETCH, then=None, schema: str = "ids binary") -> DataFrame:
    """(doc_id, ids) of every row of docs(doc_id, text): token ids as little-endian unsigned 32-bit integers.

    ``path``: a file of base64 tokens and ranks; each match of ``pattern``, which may not look behind and not
    ahead by more than LOOK_AHEAD characters, is merged by itself.  Null and empty texts have no ids.  Repeated rows and null doc_ids are kept as they are; other columns are
    ignored; no rows give no rows.  ``overlap`` must be over 0 and may not exceed ``chunk``.  ``then`` maps batches
    (doc_id, ids) on to ``schema`` in the workers that encode.
    """
    if not 0 < overlap <= chunk or stretch < 2:
        raise ValueError("overlap must be from 1 to chunk, and a stretch of two chunks at least")
    size = chunk * stretch
    small_batches(docs.sparkSession)
    encode, whole = _encode(path, pattern, chunk, overlap), lambda batches: (x[["doc_id", "ids"]] for x in _encode(path, pattern, chunk, overlap)(batches))
    alone = _chained(whole, then) if then else whole
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    several = F.coalesce(F.length("text"), F.lit(0)) > size
    # Texts of one stretch stay where they are; stretches of the others are dealt out
    one = docs.where(~several).withColumns({"first": F.lit(0), "last": F.lit(1 << 30)})
    out = through(one, alone, "doc_id", schema)
    long_docs = cut(docs.where(several).withColumn("rid", F.monotonically_increasing_id()), "long")
    if long_docs.isEmpty():
        return out
    parts = long_docs.select("rid", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int"))).alias("part"), "text")
    begin = F.greatest(F.lit(0), F.col("part") * size - chunk)
    rows = parts.select("rid", "part", F.when(F.col("part") > 0, chunk).otherwise(0).alias("first"), (F.col("part") * size + size - begin).alias("last"),
                        F.expr(f"substring(text, greatest(0, part * {size} - {chunk}) + 1, {size} + {chunk + overlap} + if(part > 0, {chunk}, 0))").alias("text"))
    done = cut(rows.repartition("rid", "part").mapInPandas(encode, "rid long, part int, ids binary, lost boolean"), "stretches")
    lost = done.where("lost").select("rid").distinct()
    whole_parts = done.join(lost, "rid", "left_anti").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("parts"))
    joined = through(long_docs.drop("text").join(whole_parts, "rid").select("doc_id", "parts"), _chained(_join_parts, then) if then else _join_parts, "doc_id", schema)
    rest = long_docs.join(lost, "rid", "left_semi").select("doc_id", "text").withColumns({"first": F.lit(0), "last": F.lit(1 << 30)})
    return out.unionByName(joined).unionByName(through(rest, alone, "doc_id", schema))


def _token_bytes(codec: tiktoken.Encoding) -> np.ndarray:
    """The bytes of each id."""
    out = np.empty(codec.n_vocab, object)
    for token in codec.token_byte_values():
        out[codec.encode_single_token(token)] = token
    return out


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw = _token_bytes(encoding(path, pattern))
        for batch in batches:
            yield batch.assign(raw=[b"".join(raw[np.frombuffer(ids, "<u4")]) for ids in batch["ids"]])

    return run


def byte_bpe_decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, raw): the bytes of each token, one after another.  No ids give no bytes; repeated rows and null
    doc_ids are kept; other columns are ignored."""
    return through(tokens.select("doc_id", "ids"), _decode(path, pattern), "doc_id", "ids binary, raw binary")


def _digest(path: str, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = encoding(path, pattern)
        names, raw = np.array([str(i) for i in range(codec.n_vocab)], object), _token_bytes(codec)
        for batch in batches:
            counts, ids_sha, raw_sha = [], [], []
            for ids in batch["ids"]:
                found = np.frombuffer(ids, "<u4")
                counts.append(len(found))
                ids_sha.append(hashlib.sha256(",".join(names[found]).encode()).hexdigest())
                raw_sha.append(hashlib.sha256(b"".join(raw[found])).hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": raw_sha, "ids": batch["ids"]})

    return run


def byte_bpe_round_trip(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, stretch: int = STRETCH) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): the ids of ``byte_bpe_encode``, and the digests of
    them, joined by commas, and of the bytes that they decode to."""
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"
    return byte_bpe_encode(docs, path, pattern, chunk, overlap, stretch, _digest(path, pattern), schema)
