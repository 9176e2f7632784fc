"""Mixing sources, against brute force."""

import hashlib
import random
import re

import pytest

from tidemark.llm.source_mix import mix_shares, mixed

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, weights=(5, 2, 1), share=1.0, repeats=3):
    """[(doc_id, size, source_size, target, taken)] by filling targets round by round and sorting everything sent."""
    docs = [(i, len(WORDS.findall(t or "")), s, hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()) for i, t, s in rows]
    total, sources = {}, sorted({d[2] for d in docs}, key=lambda s: (s is None, s or ""))
    for _, size, s, _ in docs:
        total[s] = total.get(s, 0) + size
    weight = {s: weights[n % len(weights)] for n, s in enumerate(sources)}
    full, level = set(), 0.0
    while len(full) < len(sources):
        level = (sum(total.values()) * share - sum(repeats * total[s] for s in full)) / sum(weight[s] for s in sources if s not in full)
        now = {s for s in sources if weight[s] * level >= repeats * total[s]}
        if now == full:
            break
        full = now
    target = {s: float(repeats * total[s]) if s in full else weight[s] * level for s in sources}
    sent, queue = {s: 0 for s in sources}, []
    for n, (i, size, s, place) in enumerate(sorted(docs, key=lambda d: (d[3], d[1]))):
        sent[s] += size
        queue += [((turn * total[s] + sent[s]) / target[s], sources.index(s), n) for turn in range(repeats) if size]
    taken, spent = {}, 0
    order = sorted(docs, key=lambda d: (d[3], d[1]))
    for _, _, n in sorted(queue):
        spent += order[n][1]
        if spent > sum(total.values()) * share:
            break
        taken[n] = taken.get(n, 0) + order[n][1]
    return sorted([(d[0], d[1], total[d[2]], target[d[2]], taken.get(n, 0)) for n, d in enumerate(order)], key=str)


def documents(seed, n=300):
    rng = random.Random(seed)
    out = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a"] * 6 + ["B", "c", "d", "é", None])) for i in range(n)]
    return out + [(None, "x y", "a"), (None, None, "c"), (5, "same row", "d"), (5, "same row", "d"), (n, "z " * 3000, "e"), (n + 1, "", "empty"), (n + 2, None, "empty")]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"share": 0.25}), (3, {"weights": (1.0, 10.0), "repeats": 2}), (4, {"share": 3.0}), (5, {"repeats": 1})])
def test_shares_are_those_of_brute_force(spark, seed, options):
    rows = documents(seed)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, sent int, stop_range string").repartition(5)
    got = sorted(map(tuple, mix_shares(frame, **options).collect()), key=str)
    assert got == brute(rows, **options)


def test_the_mix_in_its_order(spark):
    """Starts follow each other without a gap, the sums by document are those of the shares, targets are nearly met."""
    rows = documents(6)[:300]  # ids that differ
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    at, by = 0, {}
    for r in sorted(mixed(frame).collect(), key=lambda r: r.start):
        assert r.start == at and r.size > 0
        at += r.size
        by[r.source] = by.get(r.source, 0) + r.size
    shares = {r.source: (r.target, r.most) for r in mix_shares(frame).join(frame.select("doc_id", "source"), "doc_id").groupBy("source").agg({"target": "max", "size": "max"}).toDF("source", "target", "most").collect()}
    assert all(abs(by.get(s, 0) - target) <= most + 1 for s, (target, most) in shares.items())
    assert sum(r.taken for r in mix_shares(frame).collect()) == at


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_shares(none).collect() == [] == mixed(none).collect()
    assert [r.taken for r in mix_shares(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()] == [0]
