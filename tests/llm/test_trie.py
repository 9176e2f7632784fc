"""The prefix trie against brute force."""

import hashlib
import math
import random
import re
import zlib

import pytest

from tidemark.llm import prefix_trie
from tidemark.llm.prefix_trie import conversation_trie


def brute(rows):
    whole = {}
    sha = lambda r, t: hashlib.sha256(f"{len(r or '')}:{r or ''}{t or ''}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            whole.setdefault(c, []).append((turn is not None, turn or 0, sha(role, text), role or "", text or ""))
    seqs = {c: [x[3:] for x in sorted(turns)] for c, turns in whole.items()}
    built = {c: seqs.get(c - int(math.fmod(c, 20)), [])[: zlib.crc32(str(c).encode()) % 4] + s[zlib.crc32(str(c).encode()) % 4 :] for c, s in seqs.items()}
    members = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        leaves = sum(not any(len(y) > len(x) and y[: len(x)] == x for y in below) for x in below)
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(x) == len(node) + 1 for x in below), leaves, sum((len(members[x]) - 1) * words(x) for x in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows):
    return sorted(map(tuple, conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int, k1 string")).collect()), key=str)


@pytest.mark.parametrize("strip", [4, 32])
def test_trie_is_that_of_brute_force(spark, monkeypatch, strip):
    """Shared heads, copies, snapshots of one growing conversation, a long one, odd rows, and strips of each length."""
    monkeypatch.setattr(prefix_trie, "STRIP", strip)
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    rng, rows = random.Random(4), []
    for c in range(60):
        for turn in range(rng.randint(1, 5)):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(["a b", "c", "", "d é f"]), 0, "x"))
    for c in range(100, 111):  # snapshots
        rows += [(c, turn, "user", f"turn {turn}", 0, "x") for turn in range(c - 99)]
    rows += [(200 + c % 2, c, "user", "word", 0, "x") for c in range(24)]
    rows += [(300, None, "user", "first", 0, "x"), (300, None, None, None, 0, "x"), (300, 7, "a", None, 0, "x"), (300, 7, "a", None, 0, "x"), (300, -9, "b", "long " * 5000, 0, "x"), (None, 1, "a", "b", 0, "x"), (-7, 0, "a", "b", 0, "x"), (519, 0, "a", "gone", 0, "x")]
    assert trie(spark, rows) == brute([r[:4] for r in rows])


def test_parents_with_many_children_and_few(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HEAVY", 4)
    rows = [(1000 + 20 * i, d, "u", f"{i if d else i % 3}", 0, "x") for i in range(60) for d in range(3)]
    assert trie(spark, rows) == brute([r[:4] for r in rows])


def test_plan_does_not_grow_with_the_rounds(spark, monkeypatch):
    """A plan in which each round has scans of its own takes the driver's memory."""
    monkeypatch.setattr(prefix_trie, "STRIP", 2)
    plans = []
    for turns in (4, 12):
        rows = [(20 * c, d, "u", f"{c % 2} {d}", 0, "x") for c in range(4) for d in range(turns)]
        frame = conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int, k1 string"))
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        assert sorted(map(tuple, frame.collect()), key=str) == brute([r[:4] for r in rows])
    assert plans[0] == plans[1]


def test_no_conversations(spark):
    assert trie(spark, []) == [] == trie(spark, [(None, 1, "a", "b", 0, "x")])
