"""Prefix trie of conversations, by truncation peeling.

The trie is peeled from its deepest level: conversations that end there meet the nodes that survive from below, their
last turn is stripped, and what is left is grouped again, until the root alone is left.  A round strips a strip of
STRIP turns, as every truncation of a row within the strip is one row of the same grouping, so that conversations of
hundreds of turns take few rounds.  Nodes are found and summed up in the same pass; equal conversations are one row
from the start.

A sequence is known by a key of 128 bits, the exclusive or of hashes of its turns and their places: keys of all
prefixes are running values, and the key of a node without its last turn needs no look at the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, new_path, tidy_shuffles

#: Turns of a strip; numbers of a stretch of turns or ids, which bounds what is sorted or gathered at once.
STRIP, STRETCH = 32, 4096
#: Nodes with more than one in HEAVY of all children: there can't be more than HEAVY of them, so they are broadcast.
HEAVY = 4096
_WORDS = r"[^\x20\x09-\x0D]+"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, length, turn_sha, words): each turn's place from 1 by turn (null first; equal ones by digest), its
    conversation's length, the SHA-256 of role and text, and the words of the text.

    Null roles and texts are empty; rows without a conv_id belong to no conversation and are left out.  A long
    conversation is numbered in stretches of turn numbers."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    stretch = F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62)))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", sha.alias("turn_sha"), F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("words"), stretch.alias("stretch"))
    counts = rows.groupBy("conv_id", "stretch").agg(F.count("*").alias("n"))
    every = Window.partitionBy("conv_id").orderBy("stretch")  # one row a stretch
    bases = counts.select("conv_id", "stretch", F.coalesce(F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("conv_id")).alias("length"))
    own = Window.partitionBy("conv_id", "stretch").orderBy(F.asc_nulls_first("turn"), "turn_sha")
    return rows.withColumn("at", F.row_number().over(own)).join(bases, ["conv_id", "stretch"]).select("conv_id", (F.col("base") + F.col("at")).alias("pos"), "length", "turn_sha", "words")


def with_shared_heads(turns: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the first turns of the one that begins their block: (turns, lengths).

    Conversation c gets the first h turns of c - c % block (all if it has fewer, none if it is absent), h being the
    CRC of its decimal id modulo ``heads``, and then its own turns after its first h.  turns is as from
    ``numbered_turns``; what comes back is turns(conv_id, pos, length, turn_sha, words) and lengths(conv_id, length),
    which holds turnless conversations too."""
    crc = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    first = turns.where((F.col("pos") < heads) & (F.col("conv_id") % block == 0))
    head = first.groupBy(F.col("conv_id").alias("base_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "turn_sha", "words"))).alias("head"))  # heads - 1 turns
    convs = turns.where("pos = 1").select("conv_id", "length", (F.col("conv_id") - F.col("conv_id") % block).alias("base_id"), crc.alias("h"))
    none = F.array().cast(head.schema["head"].dataType)
    plan = convs.join(head, "base_id", "left").withColumn("head", F.slice(F.coalesce("head", none), F.lit(1), F.col("h")))
    length = F.size("head") + F.greatest(F.col("length") - F.col("h"), F.lit(0))
    plan = cut(plan.select("conv_id", "h", "head", F.size("head").alias("m"), length.alias("length")), "heads")
    given = plan.select("conv_id", "length", F.explode("head").alias("t")).select("conv_id", "t.pos", "length", "t.turn_sha", "t.words")
    own = turns.where(F.col("pos") > crc).drop("length").join(plan.select("conv_id", "h", "m", "length"), "conv_id")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "length", "turn_sha", "words")
    return given.unionByName(own), plan.select("conv_id", "length")


def _strips(turns: DataFrame) -> DataFrame:
    """(conv_id, strip, length, base, path) of each STRIP turns of a conversation: path has the keys of its prefixes that
    end there, base the key of the prefix before."""
    spark = turns.sparkSession
    key = [F.xxhash64(F.lit(i), "pos", "turn_sha").alias(f"x{i}") for i in (1, 2)]
    rows = turns.select("conv_id", "pos", "length", "words", *key, F.floor((F.col("pos") - 1) / STRIP).alias("strip"))
    w = Window.partitionBy("conv_id", "strip").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    step = F.struct("pos", F.bit_xor("x1").over(w).alias("k1"), F.bit_xor("x2").over(w).alias("k2"), "words")
    strips = rows.select("conv_id", "strip", "length", step.alias("step")).groupBy("conv_id", "strip").agg(F.first("length").alias("length"), F.array_sort(F.collect_list("step")).alias("path"))  # STRIP turns
    with tidy_shuffles(spark):
        strips.write.partitionBy("strip").parquet(path := new_path(spark, "strips"))
    found = spark.read.schema(strips.schema).parquet(path)
    before = Window.partitionBy("conv_id").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)  # one row a strip
    last = found.select("conv_id", "strip", F.element_at("path", -1).alias("end"))
    many = last.select("conv_id", "strip", F.bit_xor("end.k1").over(before).alias("b1"), F.bit_xor("end.k2").over(before).alias("b2")).where("strip > 0")
    shifted = F.expr("transform(path, x -> named_struct('pos', x.pos, 'k1', x.k1 ^ b1, 'k2', x.k2 ^ b2, 'words', x.words))")
    far = found.where("strip > 0").join(cut(many, "bases"), ["conv_id", "strip"]).select("conv_id", "strip", "length", F.struct(F.col("b1").alias("k1"), F.col("b2").alias("k2")).alias("base"), shifted.alias("path"))
    root = F.lit(0).cast("long")
    near = found.where("strip = 0").select("conv_id", "strip", "length", F.struct(root.alias("k1"), root.alias("k2")).alias("base"), "path")
    columns = ["conv_id", "strip", "length", "base", "path"]
    with tidy_shuffles(spark):
        far.unionByName(near).select(columns).write.partitionBy("strip").parquet(path := new_path(spark, "paths"))
    return spark.read.schema("conv_id bigint, length bigint, base struct<k1:bigint,k2:bigint>, path array<struct<pos:bigint,k1:bigint,k2:bigint,words:bigint>>, strip bigint").parquet(path)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a key, from its stretches of ids in order; the digest of one key is all that is held."""
    here, state = None, None
    columns = ["k1", "k2", "depth", "n", "conv_id", "ends"]
    for batch in batches:
        out = []
        for k1, k2, depth, n, least, ids in zip(batch["k1"], batch["k2"], batch["depth"], batch["n"], batch["least"], batch["ids"]):
            if here == (k1, k2):
                state[0] += n
                state[2].update(b"," + ids.encode())
                continue
            if here is not None:
                out.append((*here, state[3], state[0], state[1], state[2].hexdigest()))
            here, state = (k1, k2), [n, least, hashlib.sha256(ids.encode()), depth]
        yield pd.DataFrame(out, columns=columns)
    if here is not None:
        yield pd.DataFrame([(*here, state[3], state[0], state[1], state[2].hexdigest())], columns=columns)


def _endings(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """(k1, k2, depth, n, conv_id, ends): one row for each distinct whole conversation, with how many there are, the
    smallest, and the digest of their ids in order.  Ids are gathered by stretches of STRETCH numbers."""
    last = F.element_at("path", -1)
    root = F.lit(0).cast("long")
    whole = paths.where(last["pos"] == F.col("length")).select("conv_id", last["k1"].alias("k1"), last["k2"].alias("k2"), F.col("length").alias("depth"))
    ended = whole.unionByName(lengths.where("length = 0").select("conv_id", root.alias("k1"), root.alias("k2"), F.col("length").cast("long").alias("depth")))
    stretch = F.floor(F.col("conv_id") / STRETCH).alias("stretch")
    some = ended.groupBy("k1", "k2", stretch).agg(F.first("depth").alias("depth"), F.count("*").alias("n"), F.min("conv_id").alias("least"), F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ordered = some.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "stretch").select("k1", "k2", "depth", "n", "least", "ids")
    return cut(ordered.mapInPandas(_digests, "k1 long, k2 long, depth long, n long, conv_id long, ends string"), "endings", 10_000)


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each distinct sequence
    of first turns, the empty one included.

    turns(conv_id, pos, length, turn_sha, words) with pos from 1, lengths(conv_id, length) of all conversations, turnless
    ones too; conv_id is an integer and tells conversations apart.  conv_id and parent_conv_id are the smallest
    members of a node and of its parent, n_convs its members, n_leaves the childless nodes in its subtree, saved_tokens the
    words of last turns that members share, summed over the subtree, and ends_sha256 the digest of the ids of those
    members that have no more turns.  No conversations give no rows."""
    paths = _strips(turns)
    endings = _endings(paths, lengths)
    deepest = endings.agg(F.max("depth")).first()[0]
    if deepest is None:
        return _result(endings.select("k1", "k2", F.col("k1").alias("p1"), F.col("k2").alias("p2"), "depth", "conv_id", *(F.col("n").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), "ends"))
    zero = F.lit(0).cast("long")
    path, survivors = new_path(spark := turns.sparkSession, "nodes"), None
    for strip in range(max(0, (deepest - 1) // STRIP), -1, -1):
        inside = F.greatest(F.floor((F.col("depth") - 1) / STRIP), F.lit(0)) == strip
        pending = endings.where(inside).select("k1", "k2", "depth", "n", "conv_id", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "ends")
        if survivors is not None:  # newly ended conversations meet the nodes from below
            pending = pending.unionByName(survivors).groupBy("k1", "k2", "depth").agg(*(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")), F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"))
        nodes = _peeled(pending, paths.where(F.col("strip") == strip), strip)
        with tidy_shuffles(spark):
            nodes.write.parquet(f"{path}/strip={strip}")
        nodes = spark.read.schema(nodes.schema).parquet(f"{path}/strip={strip}")
        if strip:
            top = nodes.where(F.col("depth") == strip * STRIP + 1)
            survivors = top.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("n_convs").alias("n"), F.min("conv_id").alias("conv_id"), F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            survivors = survivors.withColumn("depth", F.lit(strip * STRIP).cast("long")).withColumn("ends", F.lit(None).cast("string"))
    return _result(spark.read.schema(nodes.schema).parquet(path))  # one table, so that the plan doesn't grow with the rounds


def _peeled(pending: DataFrame, paths: DataFrame, strip: int) -> DataFrame:
    """The nodes of one strip, from the rows that end in it or come up from below it.

    All truncations of a row are grouped by their keys, which discovers the nodes with their members; then each node's
    own leaves and words are added to itself and the nodes above it in the strip."""
    first = 0 if strip == 0 else strip * STRIP + 1
    root = F.array(F.struct(*(F.lit(0).cast("long").alias(c) for c in ("pos", "k1", "k2", "words"))))
    steps = F.coalesce("path", F.slice(root, 1, 0))
    path = F.slice(F.concat(root, steps) if strip == 0 else steps, F.lit(1), (F.col("depth") - first + 1).cast("int"))
    rows = pending.join(paths.select("conv_id", "base", "path"), "conv_id", "left").withColumn("path", path)
    cuts = rows.select("*", F.posexplode("path").alias("i", "node"))
    here = F.col("node.pos") == F.col("depth")
    own = lambda c: F.sum(F.when(here, F.col(c)).otherwise(0)).alias(c)
    nodes = cuts.groupBy(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2")).agg(
        F.first("node.pos").alias("depth"), F.first("node.words").alias("words"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.max(~here | (F.col("children") > 0)).alias("ahead"),
        own("children"), own("leaves"), own("saved"), F.max(F.when(here, F.col("ends"))).alias("ends"), F.first("base").alias("base"), F.first(F.transform(F.slice("path", F.lit(1), F.col("i") + 1), lambda x: F.struct(x["k1"].alias("k1"), x["k2"].alias("k2")))).alias("up"),
    )
    leaves = F.col("leaves") + F.when(F.col("ahead"), 0).otherwise(1)
    saved = F.col("saved") + (F.col("n") - 1) * F.col("words")
    nodes = nodes.withColumn("leaves", leaves).withColumn("saved", saved).withColumn("size", F.size("up"))
    nodes = nodes.withColumn("parent", F.when(F.col("size") > 1, F.try_element_at("up", F.col("size") - 1)).otherwise(F.col("base")))
    spread = nodes.select("*", F.posexplode("up").alias("i", "at"))
    self = F.col("i") == F.col("size") - 1
    mine = lambda c: F.max(F.when(self, F.col(c)))
    children = F.sum(F.when(self, F.col("children")).when(F.col("i") == F.col("size") - 2, 1).otherwise(0))
    return spread.groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(
        mine("parent.k1").alias("p1"), mine("parent.k2").alias("p2"), mine("depth").alias("depth"), mine("conv_id").alias("conv_id"), mine("n").alias("n_convs"), children.alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), mine("ends").alias("ends"),
    )


def _result(nodes: DataFrame) -> DataFrame:
    """Nodes with their parents' smallest members.  Parents with very many children are few and are broadcast; the others'
    children meet them by key."""
    total = nodes.agg(F.count("*").alias("total"))  # one row
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    heavy = parents.join(F.broadcast(total)).where(F.col("n_children") * HEAVY > F.col("total")).select("p1", "p2", "parent_conv_id")
    below = nodes.where("depth > 0").join(F.broadcast(heavy), ["p1", "p2"], "left")
    light = below.where("parent_conv_id IS NULL").drop("parent_conv_id").join(parents.drop("n_children"), ["p1", "p2"])
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    every = below.where("parent_conv_id IS NOT NULL").unionByName(light).unionByName(root)
    numbers = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return every.select(*(F.col(c).cast("long").alias(c) for c in numbers), F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """``prefix_trie`` of conversations(conv_id, turn, role, text, ...), rebuilt as ``with_shared_heads`` does.

    Further columns, whatever their names, are not looked at; see the inner functions for nulls, ties and empty tables."""
    turns = cut(numbered_turns(conversations.select("conv_id", "turn", "role", "text")), "turns")
    return prefix_trie(*with_shared_heads(turns, block, heads))
