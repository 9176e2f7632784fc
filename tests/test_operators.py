"""Operators on planted cases, and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators import evaluation, labels, pointintime, profile, scan, series, stats, waves
from tidemark.registry import Config, register, result_hash, trials


def make_bars(spark, rows):
    """rows: (symbol, slot, open, high, low, close, volume)"""
    frame = spark.createDataFrame(rows, "symbol string, slot long, open double, high double, low double, close double, volume double")
    return frame.withColumn("t", F.timestamp_seconds(F.col("slot") * 3600).cast("timestamp_ntz"))


def walk(seed=3, n=400, symbol="a"):
    rng, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        if rng.random() < 0.1:
            continue
        price = max(1.0, price * (1 + rng.uniform(-0.1, 0.1)))
        out.append((symbol, i, price, price * 1.02, price * 0.98, round(price, 6), float(rng.randint(0, 5))))
    return out


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(series, "CHUNK", 32)
    monkeypatch.setattr(series, "STRETCH_DAYS", 1)


def test_planted_faults(spark):
    nan = float("nan")
    rows = [("a", 0, 1.0, 2.0, 0.5, 1.5, 1.0), ("a", 1, 3.0, 2.0, 0.5, 1.5, 0.0), ("a", 2, 1.0, 2.0, 1.2, 1.5, 1.0), ("a", 5, nan, 2.0, 0.5, 1.5, 1.0), ("a", 6, -1.0, 2.0, -2.0, 1.5, 1.0), ("a", 7, 1.5, 1.0, 2.0, 1.5, 1.0)]
    got = profile.bar_quality(make_bars(spark, rows)).first()
    assert (got.rows, got.gaps, got.missing, got.ohlc_violations, got.negative_values, got.zero_volume) == (6, 1, 2, 3, 2, 1)


def test_chunked_windows_equal_whole_ones(spark, small_chunks):
    rows = walk()
    got = {r.slot: (r.prev_high, r.prev_low) for r in pointintime.breakout(make_bars(spark, rows), 12).collect()}
    for i, r in enumerate(rows):
        before = rows[max(0, i - 12) : i]
        assert got[r[1]] == ((max(x[3] for x in before), min(x[4] for x in before)) if before else (None, None))


def test_running_values_across_chunks(spark, small_chunks):
    rows = walk(5)
    got = {r.slot: (r.total, r.top) for r in series.accumulated(series.accumulated(make_bars(spark, rows), "volume", "total", F.sum, ["slot"]), "volume", "top", F.max, ["slot"], inclusive=False).collect()}
    total, top = 0.0, None
    for r in rows:
        total += r[6]
        assert got[r[1]] == (total, top)
        top = r[6] if top is None else max(top, r[6])


@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, small_chunks, strict):
    bars = make_bars(spark, walk(7))
    left, right = bars.select("symbol", "t", "slot"), bars.where("slot % 9 = 0").select("symbol", "t", F.col("close").alias("x"))
    known = [(r.slot, r.x) for r in bars.where("slot % 9 = 0").selectExpr("slot", "close AS x").orderBy("slot").collect()]
    for r in pointintime.as_of(left, right, "x", "x", strict).collect():
        before = [x for s, x in known if (s < r.slot if strict else s <= r.slot)]
        assert r.x == (before[-1] if before else None)


def test_runs(spark, small_chunks):
    bars = make_bars(spark, walk(9))
    slots, want, start = sorted(r.slot for r in bars.collect()), [], None
    for i, s in enumerate(slots):
        start = s if i == 0 or slots[i - 1] != s - 1 else start
        if i + 1 == len(slots) or slots[i + 1] != s + 1:
            want.append((start, s))
    assert sorted((r.start_slot, r.end_slot) for r in profile.runs(bars.select("symbol", "t", "slot")).collect()) == want


def test_truncation_finds_a_leak(spark):
    bars = make_bars(spark, walk(11, 120))
    assert pointintime.truncation_failures(bars, 60).count() == 0
    leaky = {"centred": (1, lambda w: F.avg("close").over(w.rowsBetween(-1, 1)))}
    assert pointintime.truncation_failures(bars, 60, leaky).count() > 0


def test_directional_changes_by_hand(spark):
    closes = [100, 95, 89, 92, 98.5, 120, 130, 116, 110, 125]
    rows = [("a", i, float(c), float(c), float(c), float(c), 1.0) for i, c in enumerate(closes)]
    got = waves.directional_changes(make_bars(spark, rows), [0.1]).orderBy("confirm_slot").collect()
    assert [(r.direction, r.extreme_slot, r.extreme, r.confirm_slot) for r in got] == [(-1, 0, 100, 2), (1, 2, 89, 4), (-1, 6, 130, 7), (1, 8, 110, 9)]
    assert all(r.extreme_slot < r.confirm_slot for r in got)


def test_barrier_tie_is_a_loss(spark):
    bars = make_bars(spark, [("a", 0, 1.0, 1.0, 1.0, 1.0, 1.0), ("a", 1, 1.0, 2.0, 0.2, 1.0, 1.0), ("a", 5, 1.0, 1.0, 1.0, 1.0, 1.0)])
    got = {r.slot: (r.barrier, r.exit_slot) for r in labels.triple_barrier(bars, bars, 0.5, 0.5, 3).collect()}
    assert got == {0: (-1, 1), 1: (0, 4), 5: (0, 8)}


def test_ntiles_and_ranks(spark):
    values = [random.Random(1).choice([1.0, 2.0, 2.0, 3.5, 9.0]) for _ in range(103)]
    frame = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    got = {r.id: r.tile for r in stats.ntiles(frame, "v", ["id"], 10, "tile").collect()}
    order = sorted(range(103), key=lambda i: (values[i], i))
    want = {i: (p // 11 if p < 33 else 3 + (p - 33) // 10) + 1 for p, i in enumerate(order)}
    assert got == want


def test_merged_intervals(spark, small_chunks):
    rng = random.Random(2)
    rows = [("a", s, s + rng.randint(0, 6)) for s in sorted(rng.sample(range(600), 120))]
    frame = spark.createDataFrame(rows, "symbol string, slot long, end_slot long").withColumn("t", F.timestamp_seconds(F.col("slot") * 3600).cast("timestamp_ntz"))
    want = []
    for _, s, e in rows:
        if want and s <= want[-1][1]:
            want[-1][1], want[-1][2] = max(want[-1][1], e), want[-1][2] + 1
        else:
            want.append([s, e, 1])
    assert sorted([r.start_slot, r.end_slot, r.events] for r in stats.merged_intervals(frame).collect()) == want


def test_splits_purge_and_embargo(spark):
    bars = make_bars(spark, walk(4, 200))
    parts = {r.split: (r.lo, r.hi) for r in evaluation.with_split(bars).groupBy("split").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).collect()}
    assert parts["train"][1] < parts["validation"][0] and parts["validation"][1] < parts["test"][0]
    kept = evaluation.embargoed(bars, 10).where("split = 'train'").agg(F.max("slot")).first()[0]
    assert kept < parts["validation"][0] - 9
    one = spark.createDataFrame([("a", 1, 5), ("a", 10, 40), ("b", 10, 40)], "symbol string, slot long, exit_slot long")
    two = spark.createDataFrame([("a", 30, 31)], "symbol string, slot long, exit_slot long")
    assert sorted((r.symbol, r.slot) for r in evaluation.purged(one, two).collect()) == [("a", 1), ("b", 10)]


def test_keys(spark):
    rows = [("x-1m-2024-01.zip",), ("x-1m-2024-01-15.zip",), ("x-1m-2024-02-01.zip",), ("x.zip",), ("x-2024-01-15.csv",)]
    frame = spark.createDataFrame(rows, "key string").withColumn("date", keys.date_of(F.col("key"))).withColumn("ok", keys.in_window(F.col("date"), "2024-01-10", "2024-01-20"))
    assert [(r.date, r.ok) for r in frame.collect()] == [("2024-01", True), ("2024-01-15", True), ("2024-02-01", False), ("", True), ("", True)]


def test_registry(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    assert result_hash(frame) == result_hash(frame.repartition(3)) != result_hash(frame.distinct())
    for name in ("one", "two"):
        register(spark, f"file://{tmp_path}/registry", name, Config(), frame, "v1")
    assert trials(spark, f"file://{tmp_path}/registry") == 2


def test_pushdown(spark):
    from tidemark.plans.tables import read

    plan = read(spark, "/root/testdata/sf0.001", "lineitem").where("l_quantity > 45").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan and "l_tax" not in plan


def test_preregistration_and_locked_test(spark, tmp_path):
    from datetime import datetime, timedelta

    from tidemark.registry import Config, locked_test, preregistered

    path, result = f"file://{tmp_path}/registry", spark.range(3)
    assert locked_test(spark, path, "final", Config(), lambda: result, "v1").count() == 3
    with pytest.raises(ValueError):
        locked_test(spark, path, "final", Config(), lambda: result, "v1")
    now = datetime.now()
    tested = spark.createDataFrame([("final", now + timedelta(days=2)), ("final", now - timedelta(days=2)), ("other", now)], "experiment string, tested_at timestamp")
    assert sorted(r.confirmatory for r in preregistered(spark, path, tested).collect()) == [False, False, True]


def test_listing_markers(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.listing import next_marker

    pages = ["<Key>a.zip</Key><Key>b.zip</Key><IsTruncated>true</IsTruncated>", "<Key>c.zip</Key><IsTruncated>false</IsTruncated>", "<IsTruncated>true</IsTruncated>"]
    assert [r[0] for r in spark.createDataFrame([(p,) for p in pages], "document string").select(next_marker(F.col("document"))).collect()] == ["b.zip", None, None]


def test_normal_distribution(spark):
    from statistics import NormalDist

    from pyspark.sql import functions as F

    from tidemark.operators.evaluation import normal_cdf, normal_quantile

    rows = spark.createDataFrame([(x / 10,) for x in range(-40, 41)], "x double").select("x", normal_cdf(F.col("x")).alias("c")).withColumn("q", normal_quantile(F.greatest("c", F.lit(0.5)))).collect()
    assert all(abs(r.c - NormalDist().cdf(r.x)) < 1e-7 and (r.x < 0.01 or abs(r.q - r.x) < 1e-3) for r in rows)


def test_order_of_frequent_values(spark):
    """Places by (value, tie), with one value in most rows, nulls, and no rows."""
    rng = random.Random(6)
    rows = [(rng.choice([1.0] * 8 + [None, 0.5, 2.0]), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "v double, i long")
    want = {i: n for n, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    assert {r.i: r.place for r in stats.ordered(frame, "v", ["i"]).collect()} == want
    assert stats.ordered(frame.limit(0), "v", ["i"]).collect() == []


@pytest.mark.parametrize(("theta", "chunk", "fan"), [(0.01, 16, 64), (0.05, 16, 2), (0.2, 8, 3), (0.4, 1, 2), (5.0, 16, 64)])
def test_chunks_of_waves_agree_with_one_fold(spark, monkeypatch, theta, chunk, fan):
    """Frequent changes, rare ones over many chunks, none at all; chunks of chunks; bars without a close; a scale."""
    monkeypatch.setattr(waves, "CHUNK", chunk)
    monkeypatch.setattr(scan, "FAN", fan)
    rng, rows = random.Random(7), []
    for symbol in ("a", "b"):
        price = 100.0
        for slot in range(160):
            price = round(price * rng.uniform(0.95, 1.052), 4)
            rows.append((symbol, slot, None if slot % 41 == 0 else float("nan") if slot % 43 == 0 else price, rng.choice([None, 0.5, 1.0, 2.0])))
    frame = spark.createDataFrame(rows, "symbol string, slot long, close double, unit double")
    known = [r for r in rows if r[2] is not None and r[2] == r[2]]
    for unit in (None, "unit"):
        scale = lambda r: theta if unit is None else float("nan") if r[3] is None else theta * r[3]  # noqa: B023, E731
        want = sorted((s, *c) for s in ("a", "b") for c in waves.fold(None, *zip(*((r[1], r[2], scale(r)) for r in known if r[0] == s)))[1])
        got = waves.directional_changes(frame, [theta], unit)
        assert sorted((r.symbol, r.direction, r.extreme_slot, r.extreme, r.confirm_slot, r.confirm) for r in got.collect()) == want
    assert waves.directional_changes(frame.limit(0), [theta]).collect() == []


def test_step_functions_of_chunks():
    """A chunk's function gives the end of a fold from any state, and a composed one that of both chunks, in any order of
    composition; ties, equal closes, thresholds of nothing and of more than one included."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    for _ in range(150):
        n, theta = int(rng.integers(2, 120)), float(rng.choice([0, 0.004, 0.01, 0.05, 0.3, 1.2]))
        closes = np.maximum(1.0, np.round(100 * np.exp(np.cumsum(rng.normal(0, rng.choice([0.003, 0.02]), n))), int(rng.choice([0, 2, 6]))))
        reversals = np.full(n, theta) if rng.random() < 0.5 else theta * rng.choice([0.1, 1, 3, np.nan], n)
        limits = sorted({0, n, *rng.integers(1, n, 3).tolist()})
        parts = [waves._summary(("a", theta, i), pd.DataFrame({"slot": np.arange(x, y) * 2, "close": closes[x:y], "reversal": reversals[x:y]})).iloc[0] for i, (x, y) in enumerate(zip(limits, limits[1:]))]
        functions = [waves._pieces(p.f) for p in parts]
        left = right = None
        for f in functions:
            left = f if left is None else waves._compose(left, f)
        for f in reversed(functions):
            right = f if right is None else waves._compose(f, right)
        for direction in (1, -1):
            for extreme in [*closes[:5], float(closes.min()) * 0.9, float(closes.max()) * 1.1, *rng.uniform(closes.min() * 0.8, closes.max() * 1.2, 5)]:
                extreme = float(extreme)
                full = (1, extreme, -1, None, None) if direction > 0 else (-1, None, None, extreme, -1)
                end, _ = waves.fold(full, (np.arange(n) * 2).tolist(), closes.tolist(), reversals.tolist())
                want = (1, end[1], end[2]) if end[0] > 0 else (-1, end[3], end[4])
                assert waves._after(left, (direction, extreme, -1)) == want == waves._after(right, (direction, extreme, -1))
