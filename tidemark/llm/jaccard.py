"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti, Kaushik 2006).

Sets are put into bands of about equal size.  In a band whose largest set has r elements, two sets of similarity
>= t differ in at most k = floor(2 r (1 - t) / (1 + t)) elements.  Elements are hashed into n1 partitions, each
divided into n2 parts.  Such a pair differs in at most k2 elements of at least g = n1 - floor(k / (k2 + 1)) of the
partitions, and there agrees on all but k2 of the parts.  So every set has a signature for each partition and each
choice of n2 - k2 of its parts, n1 * C(n2, k2) in all: a hash of what the set has in them; and the pair shares one.

A choice without elements would be shared by strangers, so it is no signature.  Sets that have such choices in g
partitions or more might lose a partner by that, and are hashed once more, by other partitions; at most RESEEDS
times, and in the last their choices without elements count too.  Of a pair, the one that needs fewer turns
guarantees a signature that holds elements, in a turn that both have.  So no link can be missed.

Each signature's documents are paired with one pivot, those that are read together first with one of them; of these
pairs each document's nearest is compared first.  Where the documents of a signature then still belong to several
components, its pairs across these are compared.  Signatures with the same first document mostly have the same
others, too, so their documents are one bucket, in which a document is once.  A bucket is compared tile by tile: it is
cut into blocks, and a tile holds two of them.  Pairs inside one component need no comparison, so a bucket's largest
component has blocks of its own, which meet those of the others alone.  A parity sketch of a few bits an element bounds how
far two sets differ from below, and rules out most pairs before their sets are fetched.  Of those that it doesn't rule out
a round compares each document's nearest, and those of each two components; what then still is in several components is
looked through again, with more of the pairs, until none is left.  So a large group of near copies takes few comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb, exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.shared import components, cut, lean, settled, small_batches, without

_SEED = np.uint64(0xD1B54A32D192ED03)
#: Widest ratio of sizes within a band.  Wider bands put fewer sets in two bands but ask for more signatures.
BAND_RATIO = 1.3
#: Elements that a signature of a band's smallest set holds on average, aimed at.
HELD = 2.5
#: Turns with other partitions, at most.
RESEEDS = 6
#: Rows of a broadcast filter on hashed ids, at most.
FILTER_BUCKETS = 1 << 20
#: Bytes of the sketches of a block, about; a tile holds two blocks.
BLOCK_BYTES = 1 << 21
#: Buckets of a sketch for each element, at least.  More tell closer pairs apart.
SKETCH_BITS = 4
#: Rows of a batch of short rows; batches of texts are of the same size in that job.
SHORT_ROWS = 4000
#: Rows of one fingerprint are dealt to so many tasks.
COPY_DEALS = 64
#: A pass deals its signatures to so many times the session's shuffle partitions: they are several times the texts, and
#: what a task fetches and sorts is held in its executor.
FINER = 2
#: Passes over the texts, each with its share of the signatures, so that so much less is in the shuffle at once.
PASSES = 2
#: Pairs of a tile that a round compares, of each document and of each two components, and the factor from round to round.
NEAREST, SPREAD = 4, 8
#: Signatures that a worker looks through together for documents that share one.
HELD_SIGNATURES = 1 << 18


def _sparse_share(low: int, n1: int, n2: int, k2: int, g: int) -> float:
    """About the share of sets of ``low`` elements of which g partitions or more have elements in k2 parts at most.

    Elements fall like rain: a part is empty with probability e, and the number of such partitions is Poisson."""
    e = exp(-low / (n1 * n2))
    mean = n1 * sum(comb(n2, j) * e**j * (1 - e) ** (n2 - j) for j in range(n2 - k2, n2 + 1))
    below = term = exp(-mean)
    for i in range(1, g):
        term *= mean / i
        below += term
    return max(0.0, 1 - below)


@lru_cache(maxsize=None)
def scheme(low: int, k: int) -> tuple[int, int, int]:
    """(n1, n2, k2) for sets of at least ``low`` elements that differ in at most k: the fewest signatures, in all turns
    that the sets may be expected to take, that hold HELD elements or more; or if there are none, the fewest."""
    options = []
    for k2 in range(1, min(k, 3) + 1):
        for n2 in range(k2 + 2, k2 + 5):
            for g in range(1, 2 + k // 2 if k > k2 else 2):
                n1 = k // (k2 + 1) + g
                turns = 1 / max(1e-3, 1 - _sparse_share(low, n1, n2, k2, g))
                options.append((low * (n2 - k2) / (n2 * n1) < HELD, n1 * comb(n2, k2) * turns, (n1, n2, k2)))
    return min(options)[2]


def bands(percent: int, largest: int) -> list[tuple[int, int, int, int, int]]:
    """Per band: its smallest size, k, n1, n2 and k2; up to the band that holds ``largest``.

    Bands of k = 0 can only link equal sets, which are joined by fingerprint; they are left out.
    """
    low, out = 1, []
    while low <= largest + 1:
        high = max(low, int(low * BAND_RATIO), low * 100 // percent)
        k = (100 - percent) * 2 * high // (100 + percent)
        if k:
            out.append((low, k, *scheme(low, k)))
            low = high + 1
        else:
            low += 1
    return out


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block of texts: (text index, hash), sorted by both, and set sizes."""
    found = K.Words(texts, K.NOT_SPACE, True)
    hashes, counts = found.hashes(), found.counts()
    grams, inside = K.ngram_hashes(hashes, words), K.within(found, words)
    doc, value = found.doc[: len(grams)][inside], grams[inside]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        whole = []
        for i in short:
            run = hashes[found.first[i] : found.first[i + 1]]
            whole.append(K.ngram_hashes(run, len(run))[0])
        doc, value = np.concatenate([doc, short]), np.concatenate([value, np.array(whole, np.uint64)])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[fresh], value[fresh]
    return doc, value, np.bincount(doc, minlength=len(texts))


def signatures(doc: np.ndarray, value: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of a block of sets, elements sorted by set: (set index, signature)."""
    found = bands(percent, int(sizes.max(initial=0)) * 100 // percent)
    outs: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    low, ends = np.array([x[0] for x in found], np.int64), np.cumsum(sizes)
    own, up = np.searchsorted(low, sizes, "right") - 1, np.searchsorted(low, sizes * 100 // percent, "right") - 1
    for band in (own, np.where(up > own, up, -1)):
        for b in np.unique(band[(band >= 0) & (sizes > 0)]).tolist():
            _, k, n1, n2, k2 = found[b]
            sets = np.flatnonzero((band == b) & (sizes > 0))
            for turn in range(RESEEDS):
                n = sizes[sets]
                at = np.repeat(ends[sets] - np.cumsum(n), n) + np.arange(n.sum())
                spread = K.mix(value[at] ^ np.uint64(int(_SEED) * (turn + 1) % (1 << 64)))
                slot = np.repeat(np.arange(len(sets)), n) * (n1 * n2) + ((spread >> np.uint64(32)) * np.uint64(n1 * n2) >> np.uint64(32)).astype(np.int64)
                sums = np.zeros(len(sets) * n1 * n2, np.uint64)
                np.add.at(sums, slot, spread * K._GOLDEN)
                sums, held = sums.reshape(-1, n1, n2), np.bincount(slot, minlength=len(sums)).reshape(-1, n1, n2)
                sparse = ((held > 0).sum(2) <= k2).sum(1) >= n1 - k // (k2 + 1)
                last = turn == RESEEDS - 1
                for c, left_out in enumerate(combinations(range(n2), k2)):
                    total, count = sums.sum(2) - sums[:, :, left_out].sum(2), held.sum(2) - held[:, :, left_out].sum(2)
                    place = K.mix(np.arange(n1, dtype=np.uint64) + np.uint64(((b * RESEEDS + turn) * 64 + c) << 32))
                    keep = (count > 0) | (sparse[:, None] & last)
                    outs.append((sets[np.nonzero(keep)[0]], K.mix(total + count.astype(np.uint64) * _SEED + place)[keep]))
                sets = sets[sparse]
                if not len(sets):
                    break
    return np.concatenate([x for x, _ in outs]), np.concatenate([x for _, x in outs])


def sketches(value: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Per set, the parity of its elements in each of 2 ** j buckets, over SKETCH_BITS buckets an element.

    Two sets differ in at least as many elements as their parities differ in buckets."""
    out = []
    for part in np.split(value, np.cumsum(sizes)[:-1]):
        bits = 1 << max(6, (SKETCH_BITS * len(part)).bit_length())
        out.append(np.packbits(np.bincount((part & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes())
    return out


def apart(x: bytes, y: bytes) -> int:
    """The number of buckets in which two sketches differ; the longer one is folded to the other's length."""
    p, q = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    bits, least = max(len(x), len(y)) * 8, min(len(x), len(y)) * 8
    p, q = (p, q) if len(x) >= len(y) else (q, p)
    while bits > least:
        bits //= 2
        p = (p >> bits) ^ (p & ((1 << bits) - 1))
    return (p ^ q).bit_count()


def _near(percent: int):
    """Pairs that the sketches don't rule out, with their distance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            far = np.array([apart(x, y) for x, y in zip(batch["sa"], batch["sb"])], np.int64)
            small, large = batch[["na", "nb"]].min(axis=1), batch[["na", "nb"]].max(axis=1)
            keep = (far <= (100 - percent) * (small + large) // (100 + percent)) & (100 * small >= percent * large)
            yield batch.assign(far=far)[keep][["a", "b", "far"]]

    return run


def _prints(value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A fingerprint of each set."""
    begin = np.concatenate([[0], np.cumsum(sizes)])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(value), dtype=np.uint64)])
    return K.mix(sums[begin[1:]] - sums[begin[:-1]] + sizes.astype(np.uint64) * K._GOLDEN)


def _shapes(words: int):
    """Each document's fingerprint, size and sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["doc_id"].to_numpy(np.int64)
            for a, z in K.blocks(texts):
                _, value, sizes = shingle_sets(texts[a:z], words)
                yield pd.DataFrame({"sig": _prints(value, sizes).view(np.int64), "n": sizes.astype(np.int32), "doc_id": ids[a:z], "sketch": sketches(value, sizes)})

    return run


def _shared(ids: list[np.ndarray], sigs: list[np.ndarray]) -> pd.DataFrame:
    """Each signature's first document here, without a pivot, and its further ones, with that as their pivot."""
    doc, sig = np.concatenate(ids), np.concatenate(sigs)
    order = np.argsort(sig, kind="stable")
    fresh = np.ones(len(sig), bool)
    fresh[1:] = sig[order][1:] != sig[order][:-1]
    pivot, first = np.empty(len(doc), np.int64), np.empty(len(doc), bool)
    pivot[order] = doc[order][fresh][np.cumsum(fresh) - 1]
    first[order] = fresh
    rows = pd.DataFrame({"sig": sig.view(np.int64), "doc_id": doc, "pivot": pd.arrays.IntegerArray(pivot, first)})
    return rows[first | (pivot != doc)]


def _signed(words: int, percent: int, part: int):
    """The signatures of one of PASSES passes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["doc_id"].to_numpy(np.int64)
            seen: set[tuple[int, int]] = set()
            for a, z in K.blocks(texts):
                doc, value, sizes = shingle_sets(texts[a:z], words)
                # equal sets of one batch send their signatures once
                first = np.ones(z - a, bool)
                for i, key in enumerate(zip(_prints(value, sizes).tolist(), sizes.tolist())):
                    first[i] = key not in seen
                    seen.add(key)
                at, sig = signatures(doc[first[doc]], value[first[doc]], np.where(first, sizes, 0), percent)
                mine = sig % np.uint64(PASSES) == part
                held[0].append(ids[a:z][at[mine]])
                held[1].append(sig[mine])
                if sum(map(len, held[1])) >= HELD_SIGNATURES:
                    yield _shared(*held)
                    held = ([], [])
        if held[0]:
            yield _shared(*held)

    return run


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, z in K.blocks(texts):
                _, value, sizes = shingle_sets(texts[a:z], words)
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[a:z], "items": np.split(value.view(np.int64), np.cumsum(sizes)[:-1])})

    return run


def _tile_pairs(tile: pd.DataFrame, percent: int, nearest: int) -> pd.DataFrame:
    """Pairs of a tile that are of different labels and not ruled out: of each document and of each two labels the
    ``nearest`` by sketch, or so.  ``again`` is the tile's bucket if there are more."""
    node, label, n, block = (tile[c].to_numpy() for c in ("node", "label", "n", "block"))
    n = n.astype(np.int64)
    width = min(map(len, tile["sketch"]))
    folded = np.zeros((len(tile), width), np.uint8)
    for i, sketch in enumerate(tile["sketch"]):
        folded[i] = np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, width), 0)
    bits = folded.view(np.uint64)
    same_block = tile["one"].iat[0] == tile["two"].iat[0]
    out, more = [np.zeros((3, 0), np.int64)], False
    least, best = np.full(len(tile), np.iinfo(np.int64).max), np.full(len(tile), -1)  # each document's nearest before
    for i in np.flatnonzero(block == tile["one"].iat[0]):
        fits = (label != label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        fits &= (node > node[i]) if same_block else (block != block[i])
        at = np.flatnonzero(fits)
        far = np.bitwise_count(bits[at] ^ bits[i]).sum(1, dtype=np.int64)
        fits = far <= (100 - percent) * (n[at] + n[i]) // (100 + percent)
        at, far = at[fits], far[fits]
        closer = far < least[at]
        least[at[closer]], best[at[closer]] = far[closer], i
        if len(at) > nearest:
            few = np.argsort(far, kind="stable")[:nearest]
            at, far, more = at[few], far[few], True
        out.append(np.stack([np.full(len(at), i), at, far]))
    met = np.flatnonzero(best >= 0)
    one, two, far = np.concatenate([*out, np.stack([best[met], met, least[met]])], 1)
    once = np.unique(one * len(tile) + two, return_index=True)[1]
    one, two, far = one[once], two[once], far[once]
    low, high = np.minimum(label[one], label[two]), np.maximum(label[one], label[two])
    order = np.lexsort((far, high, low))
    one, two, low, high = one[order], two[order], low[order], high[order]
    begins = np.ones(len(one), bool)
    begins[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    rank = np.arange(len(one)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
    few = rank < nearest
    again = tile["bucket"].iat[0] if more or not few.all() else None
    one, two = node[one[few]], node[two[few]]
    return pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two), "again": pd.array([again] * len(one), "Int64")})


def _across(percent: int, nearest: int):
    """Rows sorted by tile; one tile, of about two blocks, is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            key = held[["bucket", "one", "two"]].to_numpy()
            edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for a, z in zip(np.append(0, edge), edge):
                yield _tile_pairs(held.iloc[a:z], percent, nearest)
            held = held.iloc[edge[-1] :] if len(edge) else held
        if held is not None and len(held):
            yield _tile_pairs(held, percent, nearest)

    return run


def _linked(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets are similar enough, by exact comparison."""
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    # A first semi-join by hash bucket, of at most FILTER_BUCKETS rows, keeps most other texts out of the shuffle
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BUCKETS)).cast("int").alias("bucket")
    near = docs.withColumn("bucket", bucket).join(F.broadcast(ids.select(bucket).distinct()), "bucket", "left_semi")
    sets = cut(near.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInPandas(lean(_sets(words)), "doc_id long, items array<long>"), "sets")
    one = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    both = (F.size("x") + F.size("y")).cast("long")
    return pairs.join(one, "a").join(two, "b").select("a", "b", shared.alias("same"), both.alias("both")).where(F.lit(100) * F.col("same") >= F.lit(percent) * (F.col("both") - F.col("same"))).select("a", "b").distinct()


def _tiled(rows: DataFrame) -> DataFrame:
    """rows(bucket, node, label, n, sketch) with their block, once for each tile (bucket, one, two) that they are in.

    Labels fill blocks 0 to rest - 1 of a bucket, but the most frequent one has blocks of its own behind them; no tile
    holds two of these.  A bucket of one block's size is one block, and one of a single label has no tile.
    """
    size = rows.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.sum(F.length("sketch")).alias("held"))
    largest = F.max(F.struct("c", "label", "held")).alias("largest")
    size = size.groupBy("bucket").agg(largest, F.sum("held").alias("held"), F.count("*").alias("labels")).where("labels > 1")
    alone = F.col("held") <= BLOCK_BYTES
    parts = lambda held: F.ceil(held / BLOCK_BYTES).cast("long")
    size = size.select("bucket", F.col("largest.label").alias("main"), F.when(alone, 1).otherwise(parts(F.col("held") - F.col("largest.held"))).alias("rest"), F.when(alone, 0).otherwise(parts(F.col("largest.held"))).alias("own"))
    size = cut(size, "blocks")  # written, so that Spark can split a bucket in the join
    apart_from = (F.col("own") > 0) & (F.col("label") == F.col("main"))
    block = F.when(apart_from, F.col("rest") + F.pmod(F.xxhash64("node"), F.greatest(F.col("own"), F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest")))
    dealt = rows.join(size, "bucket").withColumn("block", block)
    last = F.when(apart_from, F.col("rest")).otherwise(F.col("rest") + F.col("own")) - 1
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    dealt = dealt.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    tile = ["bucket", "one", "two"]
    return dealt.select(*tile, "block", "node", "label", "n", "sketch").repartition(*tile).sortWithinPartitions(*tile, "node")


def ngram_jaccard_classes(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text).

    Sets are distinct ``words``-word shingles of the text, A-Z lowered, words ending at ASCII white space; a
    shorter text is one shingle.  Documents link when 100 * |intersection| >= percent * |union|.
    component_id is the smallest doc_id reachable.  Null or blank texts have 0 shingles and link with
    nothing.  A null doc_id has a null component.  Repeated rows are returned as often as given; rows of one
    doc_id with different texts count as one node.  An empty table gives no rows; other columns are ignored.

    The result is a written table; all other tables written on the way are deleted.
    """
    return settled(docs.sparkSession, "classes", lambda: _classes(docs, words, percent))


def _classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id is not null")
    # Every document with the first of the equal sets that are dealt together; sets without elements alone
    deal = F.pmod(F.xxhash64("doc_id"), F.lit(COPY_DEALS))
    by = Window.partitionBy("sig", "n", "deal").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sets = known.mapInPandas(lean(_shapes(words)), "sig long, n int, doc_id long, sketch binary").withColumn("deal", deal)
    sets = cut(sets.withColumn("pivot", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.first("doc_id").over(by))).drop("deal"), "shapes")
    # Equal sets: the first of each deal, and of these the first
    leads = sets.where("doc_id = pivot and n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    moved = cut(sets.where("doc_id = pivot and n > 0").join(leads, ["sig", "n"]).where("doc_id <> rep").groupBy(F.col("doc_id").alias("pivot")).agg(F.min("rep").alias("rep")), "moved")
    members = sets.join(moved, "pivot", "left").select("doc_id", F.coalesce("rep", "pivot").alias("rep"), F.col("n").cast("long").alias("n_shingles"))
    copies = cut(members.where("doc_id <> rep").groupBy("doc_id").agg(F.min("rep").alias("rep")), "copies")
    shapes = sets.where("doc_id = pivot").select("doc_id", "n", "sketch")
    # Of equal sets, that of the smallest id has the signatures; ids that have no such set are spared
    signing = sets.where("doc_id = pivot and n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    spared = cut(sets.select("doc_id").distinct().join(signing, "doc_id", "left_anti"), "spared")
    texts = without(known, spared, "doc_id")
    # Every further document of a signature with the signature's first, its pivot, unless it has one already
    deal = F.when(F.col("pivot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("doc_id"), F.lit(COPY_DEALS)))
    by = Window.partitionBy("sig", "deal").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = None
    for part in range(PASSES):  # the shuffle files of a pass go before the next
        rows = texts.mapInPandas(lean(_signed(words, percent, part)), "sig long, doc_id long, pivot long").withColumn("deal", deal)
        rows = rows.repartition(FINER * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sig", "deal")
        rows = rows.select("sig", F.coalesce("pivot", F.first("doc_id").over(by)).alias("p"), F.col("doc_id").alias("q")).where("p <> q")
        rows = cut(rows, "buckets", SHORT_ROWS)
        met = rows if met is None else met.unionByName(rows)

    def to_rep(frame: DataFrame, column: str, out: str) -> DataFrame:
        known_rep = copies.select(F.col("doc_id").alias(column), F.col("rep").alias("_rep"))
        return frame.join(known_rep, column, "left").withColumn(out, F.coalesce("_rep", column)).drop("_rep")

    def likely(pairs: DataFrame) -> DataFrame:
        one, two = shapes.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), shapes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"))
        pairs = pairs.join(one, "a").join(two, "b").where(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))
        one, two = shapes.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa")), shapes.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb"))
        return pairs.join(one, "a").join(two, "b").mapInPandas(lean(_near(percent)), "a long, b long, far long").groupBy("a", "b").agg(F.min("far").alias("far"))

    stars = cut(to_rep(to_rep(met.select("p", "q").distinct(), "p", "pr"), "q", "qr").where("pr <> qr"), "stars")
    first = cut(likely(stars.select(F.least("pr", "qr").alias("a"), F.greatest("pr", "qr").alias("b")).distinct()), "pairs")
    ends = first.select("a", "b", "far", F.explode(F.array("a", "b")).alias("node"))
    nearest = ends.groupBy("node").agg(F.min(F.struct("far", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
    tried = cut(nearest, "tried")
    edges = cut(_linked(known, tried, words, percent), "edges")
    label = settled(docs.sparkSession, "labels", lambda: components(edges))

    def labelled(frame: DataFrame, column: str, out: str) -> DataFrame:
        known_label = label.select(F.col("node").alias(column), F.col("component").alias("_label"))
        return frame.join(known_label, column, "left").withColumn(out, F.coalesce("_label", column)).drop("_label")

    # Signatures whose documents are still in several components: a pivot and another document are, as pivots are linked
    odd = cut(labelled(labelled(stars, "pr", "pl"), "qr", "ql").where("pl <> ql").select("p", "q"), "odd")
    across = cut(labelled(labelled(first.select("a", "b"), "a", "al"), "b", "bl").where("al <> bl").select("a", "b"), "across")
    rows = None
    split = cut(met.join(odd, ["p", "q"], "left_semi").select("sig").distinct(), "split")
    if not split.isEmpty():
        there = met.join(split, "sig", "left_semi")
        seats = there.select("sig", F.col("q").alias("node")).unionByName(there.select("sig", F.col("p").alias("node")).distinct())
        seats = cut(to_rep(seats, "node", "rep").select("sig", F.col("rep").alias("node")).distinct(), "seats")
        # Two documents are a pair of which the sketches were compared
        heads = seats.groupBy("sig").agg(F.min("node").alias("bucket"), F.count("*").alias("c")).where("c > 2").drop("c")
        rows = labelled(seats.join(heads, "sig").select("bucket", "node").distinct(), "node", "label").join(shapes.withColumnRenamed("doc_id", "node").dropDuplicates(["node"]), "node")
        rows = cut(rows.select("bucket", "node", "label", "n", "sketch"), "rows")
    limit = NEAREST
    while True:
        again = None
        if rows is not None:
            found = cut(_tiled(rows).mapInPandas(lean(_across(percent, limit)), "a long, b long, again long"), "found", SHORT_ROWS)
            pairs, again = found.select("a", "b"), found.where("again is not null").select(F.col("again").alias("bucket")).distinct()
            across = pairs if across is None else across.unionByName(pairs)
        fresh = cut(across.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        if not fresh.isEmpty():
            tried, linked = tried.unionByName(fresh), cut(_linked(known, fresh, words, percent), "edges")
            if not linked.isEmpty():
                edges = edges.unionByName(linked)
                label = settled(docs.sparkSession, "labels", lambda: components(edges))
        if again is None or again.isEmpty():
            break
        # Pairs that haven't been compared, where documents belong to several components still
        rows = cut(labelled(rows.drop("label").join(again, "bucket", "left_semi"), "node", "label").select("bucket", "node", "label", "n", "sketch"), "rows")
        across, limit = None, limit * SPREAD
    out = members.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    nameless = docs.where("doc_id is null").mapInPandas(lean(_counts(words)), "doc_id long, n_shingles long, component_id long")
    return out.unionByName(nameless)


def _counts(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, z in K.blocks(texts):
                _, _, sizes = shingle_sets(texts[a:z], words)
                yield pd.DataFrame({"doc_id": pd.array([None] * (z - a), "Int64"), "n_shingles": sizes, "component_id": pd.array([None] * (z - a), "Int64")})

    return run
