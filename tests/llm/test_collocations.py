"""Collocations against brute force."""

import random
import re
from pathlib import Path

import pytest

from tidemark.llm import collocations
from tidemark.llm.collocations import phrase_collocations
from tidemark.llm.shared import shared_dir


def brute(rows, longest=4, least=30, percent=80, top=2000):
    counts, total = {}, {}
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            total[lang] = total.get(lang, 0) + len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    p = tuple(w[i : i + k])
                    counts.setdefault(lang, {})[p] = counts.get(lang, {}).get(p, 0) + 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        covered = {}
        for q, a in often.items():
            for n in range(2, len(q)):
                for i in range(len(q) - n + 1):
                    covered[q[i : i + n]] = max(a, covered.get(q[i : i + n], 0))
        kept = []
        for p, a in often.items():
            if p in covered and 100 * covered[p] >= percent * a:
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, n, p.decode(), -a, left, right, total[lang], -score) for n, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "options"), [(50, {"least": 3}), (1 << 18, {"least": 5, "top": 4, "percent": 95}), (50, {"least": 2, "longest": 3})])
def test_collocations_are_those_of_brute_force(spark, monkeypatch, block, options):
    """Hot words, repeated words, rows that repeat, odd spaces and marks, several languages, a very long text."""
    monkeypatch.setattr(collocations, "BLOCK", block)
    rng = random.Random(8)
    word = lambda: rng.choice(["the"] * 6 + ["of", "New", "york", "city", "a\xa0b", "x\x1cy", "éa", "Éa", "\U0001f600", "z"])
    rows = [(rng.choice(["en", "en", "de", None]), "".join(word() + rng.choice([" "] * 6 + ["\t", "  ", ", ", ".", "\n", "\r\n", "?! "]) for _ in range(rng.randrange(30)))) for _ in range(150)]
    rows += [("en", None), ("fr", ""), ("und", "the of the of"), ("en", "in the city of New York " * 400), ("xx", "a a a a a a"), *[("de", "same row of words")] * 7]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, first int, block string").repartition(4)
    assert sorted(map(tuple, phrase_collocations(frame, **options).collect())) == brute(rows, **options)


def test_relations_and_groups_are_deleted(spark):
    def tables():
        return {p for p in (Path(shared_dir(spark).removeprefix("file://")) / "tidemark").glob("*-*")}

    before, rows = tables(), [("en", "a b c d e")] * 40
    assert sorted(map(tuple, phrase_collocations(spark.createDataFrame(rows, "lang string, text string")).collect())) == brute(rows)
    assert {p.name.split("-")[0] for p in tables() - before} == {"totals", "frequent"}


def test_no_texts(spark):
    assert phrase_collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert phrase_collocations(spark.createDataFrame([(None, None), ("en", " . ")], "lang string, text string")).collect() == []


def test_relations_of_two_lengths_are_never_there_whole(spark, monkeypatch):
    """A part of a relation goes before the next part of the next length is written."""
    root, seen, remove = Path(shared_dir(spark).removeprefix("file://")) / "tidemark", [], collocations.delete
    before = set(root.glob("*-*"))

    def noting(spark, path):
        seen.append(sorted((p.parent.name.split("-")[0], p.name) for p in root.glob("*-*/part=*") if p.parent not in before))
        remove(spark, path)

    monkeypatch.setattr(collocations, "delete", noting)
    rows = [(lang, "w a b c d e. " * 3) for lang in ("de", "en", "fr", "xx") for _ in range(10)]  # a block of each in a task
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert sorted(map(tuple, phrase_collocations(frame, least=5).collect())) == brute(rows, least=5)
    parts = [f"part={p}" for p in range(collocations.PASSES)]
    assert seen[: collocations.PASSES] == [[("occurrences", q) for q in parts[: n + 1]] + [("words", q) for q in parts[n:]] for n in range(collocations.PASSES)]

