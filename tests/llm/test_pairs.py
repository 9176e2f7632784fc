"""N-gram Jaccard join, decontamination and components, against brute force."""

import hashlib
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from cases import ODD

from tidemark.llm import decontaminate, jaccard
from tidemark.llm.decontaminate import benchmark_overlap
from tidemark.llm.jaccard import ngram_jaccard_classes
from tidemark.llm.shared import components, cut, settled, shared_dir, without

def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def classes(rows, k, percent):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return sorted([(i, len(shingles(t, k)), top(i)) for i, t in rows if i is not None] + [(-1, len(shingles(t, k)), -1) for i, t in rows if i is None])


def near_copies(seed, groups=12, size=9, spread=8):
    rng = random.Random(seed)
    out, n = [], 100
    for g in range(groups):
        length = rng.choice([3, 5, 7, 9, 14, 30, 80, 200])
        base = [f"w{rng.randrange(500)}" for _ in range(length)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(1 + max(1, length // spread))):
                words[rng.randrange(length)] = f"v{rng.randrange(500)}"
            if rng.random() < 0.3:
                words = words[: max(1, length - rng.randrange(3))]
            out.append((n, " ".join(words)))
            n += 1
    return out


def tables(spark):
    return {p for p in (Path(shared_dir(spark).removeprefix("file://")) / "tidemark").glob("*-*")}


@pytest.mark.parametrize(("k", "percent", "held"), [(4, 85, 1), (5, 80, 1 << 18), (2, 60, 500)])
def test_classes_equal_brute_force(make, k, percent, held, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 64)  # many tiles
    monkeypatch.setattr(jaccard, "HELD_SIGNATURES", held)
    rows = near_copies(k) + ODD
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in ngram_jaccard_classes(make(rows), k, percent).collect()]
    assert sorted(got) == classes(rows, k, percent)


def test_template_with_few_links(make, spark):
    """A passage that all share, before texts of their own: nearly alike, so that they share signatures, but few link."""
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"o{rng.randrange(10_000)}" for _ in range(15))) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 60, 3)]
    got = [tuple(r) for r in ngram_jaccard_classes(make(rows)).collect()]
    assert sorted(got) == classes(rows, 5, 80)
    assert len({c for _, _, c in got}) == 150


def test_large_group_of_near_copies_takes_few_comparisons(make, monkeypatch):
    """In several components after the nearest pairs: not all pairs of these are compared, and no link is lost."""
    rng, rows, compared = random.Random(11), [], []
    base = [f"w{i}" for i in range(90)]
    for i in range(160):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(90)] = f"v{i} {rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    linked = jaccard._linked
    monkeypatch.setattr(jaccard, "_linked", lambda docs, pairs, *a: (compared.append(pairs.count()), linked(docs, pairs, *a))[1])
    got = [tuple(r) for r in ngram_jaccard_classes(make(rows), 5, 60).collect()]
    assert sorted(got) == classes(rows, 5, 60)
    assert sum(compared) < 12 * len(rows)


def test_shuffle_files_go_once_a_table_is_written(make, spark):
    here = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in here.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = files()
    made = cut(make([(i, "a") for i in range(100)]).groupBy("doc_id").count(), "counts")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and made.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_tiles_hold_each_pair_of_labels_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 64)
    rng = random.Random(5)
    rows = [(b, b * 1000 + i, 7 if rng.random() < 0.6 else rng.randrange(20), 10, bytes(8)) for b, size in enumerate([3, 8, 9, 60, 200]) for i in range(size)]
    rows += [(9, 9000 + i, 1, 10, bytes(8)) for i in range(30)]
    found = {}
    for r in jaccard._tiled(spark.createDataFrame(rows, "bucket long, node long, label long, n int, sketch binary")).collect():
        found.setdefault((r.bucket, r.one, r.two), []).append((r.block, r.node, r.label))
    met = []
    for (bucket, one, two), held in found.items():
        both = [(x, y) for x in held for y in held if x[1] < y[1] and {x[0], y[0]} == {one, two} and x[2] != y[2]]
        met += [(bucket, x[1], y[1]) for x, y in both]
    want = [(b, x, y) for b, x, lx, *_ in rows for b2, y, ly, *_ in rows if b == b2 and x < y and lx != ly]
    assert sorted(met) == sorted(want)
    common = max({lab: sum(r[0] == 4 and r[2] == lab for r in rows) for lab in range(20)}.items(), key=lambda x: x[1])[0]
    assert all(len({x[2] for x in held}) > 1 or held[0][2] != common for (b, *_), held in found.items() if b == 4)
    assert all(b != 9 for b, *_ in found)  # one label: no tile


def test_settled_leaves_its_result_alone(make, spark):
    before = tables(spark)
    out = settled(spark, "kept", lambda: cut(settled(spark, "inner", lambda: cut(make([(1, "a"), (2, None)]), "one")), "two"))
    assert sorted(r.doc_id for r in out.collect()) == [1, 2]
    assert [p.name.split("-")[0] for p in tables(spark) - before] == ["kept"]
    with pytest.raises(ZeroDivisionError):
        settled(spark, "kept", lambda: cut(make([(1, "a")]), "one").limit(1 // 0))
    ngram_jaccard_classes(make(near_copies(1, groups=2)))
    assert sorted(p.name.split("-")[0] for p in tables(spark) - before) == ["classes", "kept"]
    assert cut(make([]), "outside").count() == 0


def test_no_rows(make):
    assert ngram_jaccard_classes(make([])).collect() == []
    assert benchmark_overlap(make([]), make([(1, "a b")], "item_id")).collect() == []


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_similar_sets_share_a_signature(percent):
    """Random pairs at the threshold, sizes 1 to 400, hold a signature in common."""
    rng = np.random.default_rng(percent)
    tried = 0
    for _ in range(600):
        n = int(rng.integers(1, 400))
        allowed = (100 - percent) * 2 * n // (100 + percent)
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[: n - allowed // 2], rng.integers(0, 2**63, allowed - allowed // 2, dtype=np.uint64)])
        same, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        if 100 * same < percent * union or same == union:
            continue
        tried += 1
        sizes = np.array([len(x), len(y)])
        doc, value = np.repeat([0, 1], sizes), np.concatenate([np.sort(x), np.sort(y)])
        at, sig = jaccard.signatures(doc, value, sizes, percent)
        assert set(sig[at == 0].tolist()) & set(sig[at == 1].tolist())
        sketch = jaccard.sketches(value, sizes)
        assert jaccard.apart(*sketch) <= len(np.setxor1d(x, y))
    assert tried > 200


def test_signatures_are_the_enumerated_subsets():
    """n1 * C(n2, k2) for each band, each the content of n2 - k2 parts of one partition: a change of one element
    changes those of its partition whose choice has its part, and no others."""
    from math import comb

    rng = np.random.default_rng(1)
    for n in (30, 110, 130, 400):
        value = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64))
        low, k, n1, n2, k2 = [b for b in jaccard.bands(85, 1000) if b[0] <= n][-1]
        other = [b for b in jaccard.bands(85, 1000) if b[0] <= n * 100 // 85][-1]
        assert k2 >= 1 and n2 - k2 >= 2 and n1 - k // (k2 + 1) >= 1
        at, sig = jaccard.signatures(np.zeros(n, np.int64), value, np.array([n]), 85)
        want = n1 * comb(n2, k2) + (other[2] * comb(other[3], other[4]) if other != (low, k, n1, n2, k2) else 0)
        assert 0.8 * want < len(sig) <= 1.05 * want
        _, less = jaccard.signatures(np.zeros(n - 1, np.int64), value[1:], np.array([n - 1]), 85)
        if [b for b in jaccard.bands(85, 1000) if b[0] <= (n - 1) * 100 // 85][-1] == other and low <= n - 1:
            changed = comb(n2 - 1, k2) + (comb(other[3] - 1, other[4]) if other != (low, k, n1, n2, k2) else 0)
            assert len({*sig.tolist()} - {*less.tolist()}) == changed


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(200, x) for x in range(201, 240)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(40)] + [(500, 500)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_without(make, spark):
    rows = [(i, str(i)) for i in range(50)] + [(None, "n")]
    got = without(make(rows), spark.createDataFrame([(3,), (7,), (99,)], "doc_id long"), "doc_id").collect()
    assert sorted(r.text for r in got) == sorted(t for i, t in rows if i not in (3, 7))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def overlap(rows, items, window):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if got := grams.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= got
        named = sorted(str(x) for x in found if x is not None)
        out.append((-1 if doc is None else doc, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_overlap_equals_brute_force(make):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)] + ["Straße", "É1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 6, 9, 10, 11, 25, 40])))) for i in range(30)] + [(99, None), (None, "w1 w2 w3 w4")]
    rows = list(ODD)
    for i in range(100, 160):
        text = rng.choices(vocabulary, k=rng.randrange(60))
        for _ in range(rng.randrange(3)):
            piece = words(rng.choice(items)[1])
            a = rng.randrange(len(piece) + 1)
            text[rng.randrange(len(text) + 1) :] = [*piece[a : a + rng.randrange(30)], *rng.choices(vocabulary, k=5)]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    got = benchmark_overlap(make(rows), make(items, "item_id"))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == overlap(rows, items, 10)


def test_no_items(make):
    assert not any(r.contaminated for r in benchmark_overlap(make(ODD), make([], "item_id")).collect())


def test_every_shared_window_holds_a_fingerprint():
    from tidemark.llm import kernels as K

    rng = random.Random(3)
    text = " ".join(rng.choices("abcdefg", k=300))
    w = K.Words([text], K.ALNUM, True)
    at, _ = decontaminate.winnow(w, w.hashes(), 5, 10)
    assert all(((at >= i) & (at + 5 <= i + 10)).any() for i in range(300 - 10 + 1))
