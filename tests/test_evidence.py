"""Positions that exclude each other, and the stationary bootstrap, against plain Python and numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, models, positions, scan, series, stats


def greedy(trades):
    out, free = [], {}
    for symbol, slot, exit_slot, tie in sorted(trades):
        if slot >= free.get(symbol, slot):
            out.append((symbol, slot, exit_slot, tie))
            free[symbol] = exit_slot
    return out


@pytest.mark.parametrize(("chunk", "fan", "longest"), [(4, 2, 3), (16, 2, 60), (7, 64, 400), (4096, 64, 10)])
def test_exclusive_positions(spark, monkeypatch, chunk, fan, longest):
    """Trades that are short, or longer than many chunks; several at a slot; none held at all; one symbol with most."""
    monkeypatch.setattr(positions, "CHUNK", chunk)
    monkeypatch.setattr(scan, "FAN", fan)
    monkeypatch.setattr(series, "STRETCH_DAYS", 2)
    rng, trades = random.Random(longest), []
    for i in range(400):
        slot = rng.randrange(900)
        trades.append((rng.choice("aaaab"), slot, slot + rng.randrange(longest), i))
    frame = spark.createDataFrame(trades, "symbol string, slot long, exit_slot long, i long")
    want = sorted(greedy([(s, a, b, i) for s, a, b, i in trades]))
    got = sorted(map(tuple, positions.exclusive(frame.orderBy("i"), ["exit_slot", "i"]).select("symbol", "slot", "exit_slot", "i").collect()))
    assert got == want
    assert positions.exclusive(frame.limit(0)).collect() == []


def draws(spark, m, replicates, mean_block):
    times = np.zeros((replicates, m))
    for r in stats.stationary_draws(spark.createDataFrame([(m,)], "m long"), replicates, mean_block).collect():
        times[r.rep, r.block] += r.times
    return times


def test_draws_are_blocks_of_geometric_length(spark):
    times = draws(spark, 400, 50, 5)
    assert (times.sum(axis=1) == 400).all() and abs(times.mean(axis=0) - 1).max() < 0.8
    assert np.array_equal(times, draws(spark, 400, 50, 5))
    together = np.mean([np.corrcoef(t[:-1], t[1:])[0, 1] for t in times])
    assert 0.7 < together < 0.9  # neighbours are drawn together four times of five
    assert abs(np.mean([np.corrcoef(t[:-1], t[1:])[0, 1] for t in draws(spark, 400, 50, 1)])) < 0.05


def test_intervals_hold_the_mean_as_often_as_they_say(spark):
    """240 series of which neighbours correlate: single draws would give intervals far too short."""
    rng, rows = np.random.default_rng(3), []
    for k in range(240):
        x = rng.normal(0, 1, 200)
        for i in range(1, 200):
            x[i] += 0.5 * x[i - 1]
        rows += [(k, i, float(v), 1) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "key int, block long, s double, n long")
    share = lambda mean_block: stats.bootstrap_interval(frame, 200, mean_block, "key").agg(F.avg(F.expr("int(lower <= 0 AND upper >= 0)"))).first()[0]
    assert 0.87 < share(12) < 0.98 and share(1) < 0.82


def test_superior_ability_by_hand(spark):
    """Three recentrings, a strategy far below the benchmark, one without any deviation, absent periods."""
    m, replicates = 60, 100
    rng = np.random.default_rng(1)
    x = np.stack([rng.normal(0.1, 1, m), rng.normal(0.3, 1, m), rng.normal(-3, 0.5, m), np.zeros(m), rng.normal(-0.05, 2, m)])
    x[4, ::3] = 0
    rows = [(f"s{k}", i, float(x[k, i])) for k in range(5) for i in range(m) if x[k, i] or k == 3]
    times = draws(spark, m, replicates, 4)
    gain, again = x.mean(axis=1), times @ x.T / m
    omega = np.sqrt(m * ((again - gain) ** 2).mean(axis=0))
    keep = omega > 1e-12
    gain, again, omega = gain[keep], again[:, keep], omega[keep]
    statistic = max(0, (np.sqrt(m) * gain / omega).max())
    centres = {"lower": np.maximum(gain, 0), "consistent": np.where(gain >= -omega / np.sqrt(m) * np.sqrt(2 * np.log(np.log(m))), gain, 0), "upper": gain}
    got = stats.superior_ability(spark.createDataFrame(rows, "key string, block long, x double"), replicates, 4, "key").first()
    assert (got.strategies, got.periods) == (4, m) and got.statistic == pytest.approx(statistic)
    for name, centre in centres.items():
        best = np.maximum(0, (np.sqrt(m) * (again - centre) / omega).max(axis=1))
        assert got[f"p_{name}"] == pytest.approx((best > statistic + 1e-9).mean())
    assert got.p_lower <= got.p_consistent <= got.p_upper
    assert stats.superior_ability(spark.createDataFrame([], "key string, block long, x double"), 10, 4, "key").collect() == []


def test_logistic_regressions_of_folds(spark):
    """Every fold's coefficients are those of Newton's method in numpy; a fold without rows has none, nulls don't count."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (600, 3))
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -2.0, 0.0])))).astype(int)
    fold = rng.integers(0, 3, 600) * 2
    rows = [(int(f), *map(float, v), int(u)) for f, v, u in zip(fold, x, y)]
    frame = spark.createDataFrame([*rows, (0, None, 1.0, 1.0, 1), (0, 1.0, 1.0, 1.0, None)], "fold int, a double, b double, c double, up int").repartition(5)
    got = dict(models.logistic(frame, ["a", "b", "c"], "up", 6, 0.5))
    assert sorted(got) == [0, 2, 4]
    for f, beta in got.items():
        z, u, want = np.column_stack([np.ones((fold == f).sum()), x[fold == f]]), y[fold == f], np.zeros(4)
        penalty = np.diag([0, 0.5, 0.5, 0.5])
        for _ in range(6):
            p = 1 / (1 + np.exp(-z @ want))
            want = want + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (u - p) - penalty @ want)
        assert beta == pytest.approx(want.tolist(), abs=1e-9)
    scored = models.with_probability(frame.dropna(), {0: got[0]}, ["a", "b", "c"])
    assert scored.count() == (fold == 0).sum() and scored.select(F.avg(models.log_loss(F.col("up"), F.col("p")))).first()[0] < 0.6
    assert models.logistic(frame.limit(0), ["a"], "up") == []


def test_folds_keep_labels_out_of_their_tests(spark):
    """The last training label ends more than the embargo before the test begins; each row is tested once at most."""
    dealt = evaluation.fold_samples(spark.range(500).select(F.col("id").alias("slot")), 0, 100, 40, 10, 4, 12)
    for r in dealt.groupBy("fold").agg(F.max(F.expr("IF(part = 'train', slot, null)")).alias("train"), F.min(F.expr("IF(part = 'test', slot, null)")).alias("test"), F.count_if(F.col("part") == "train").alias("n")).collect():
        assert (r.test, r.train, r.n) == (100 + 40 * r.fold, r.test - 17, r.test - 16)
    assert dealt.where("part = 'test'").count() == dealt.where("part = 'test'").select("slot").distinct().count() == 400
    assert evaluation.fold_samples(spark.range(5).select(F.col("id").alias("slot")), 0, 100, 40, 0, 4, 12).count() == 0


def test_boosted_trees_find_what_lines_cannot(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), int(a * b > 0), "train" if i < 300 else "test") for i, (a, b) in enumerate(rng.normal(0, 1, (500, 2)))]
    scored = models.boosted(spark.createDataFrame(rows, "a double, b double, up int, split string"), ["a", "b"], "up")
    assert scored.where("split = 'test'").select(F.avg(F.expr("int((p >= 0.5) = (up = 1))"))).first()[0] > 0.9


@pytest.mark.parametrize(("count", "batch"), [(2, 256), (6, 2), (8, 3)])
def test_overfitting_of_all_halves(spark, count, batch):
    """Absent blocks, strategies without rows on one side, equal means, batches of few strategies."""
    from itertools import combinations

    rng = random.Random(count)
    rows = [(f"s{k}", b, float(rng.randint(-3, 3)), rng.randint(1, 3)) for k in range(9) for b in range(count) if k not in (3, 4) or b < count // 2 or rng.random() < 0.3]
    want = []
    for half in combinations(range(count), count // 2):
        means = []
        for k in range(9):
            total = {side: [sum(r[c] for r in rows if r[0] == f"s{k}" and (r[1] in half) == side) for c in (2, 3)] for side in (True, False)}
            if total[True][1] and total[False][1]:
                means.append((f"s{k}", *(round(total[side][0] / total[side][1], 9) for side in (True, False))))
        best = min(means, key=lambda m: (-m[1], m[0]))[0]
        place = [m[0] for m in sorted(means, key=lambda m: (m[2], m[0]))].index(best) + 1
        want.append((sum(1 << b for b in half), best, place, len(means)))
    frame = spark.createDataFrame(rows, "strategy string, block int, s double, n long").repartition(3)
    assert sorted(map(tuple, evaluation.overfitting(frame, count, batch).collect())) == sorted(want)
    assert evaluation.overfitting(frame.limit(0), count).collect() == []
