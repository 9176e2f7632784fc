"""The feature table: recursions across chunks, and no feature that looks ahead."""

import re

import pytest
from pyspark.sql import functions as F
from test_operators import make_bars, walk

from tidemark.operators import features, scan, series
from tidemark.operators.features import Feature, feature_table


@pytest.fixture
def bars(spark, monkeypatch):
    monkeypatch.setattr(series, "CHUNK", 32)
    monkeypatch.setattr(series, "STRETCH_DAYS", 1)
    monkeypatch.setattr(scan, "FAN", 2)
    return make_bars(spark, walk(3) + walk(4, 90, "b")).withColumn("n", F.lit(2).cast("long"))


def test_recursions_across_chunks(bars):
    """Means that carry on over chunks and chunks of chunks are those of a plain loop; missing values change nothing."""
    frame = bars.withColumn("close", F.when(F.col("slot") % 7 == 3, None).otherwise(F.col("close")))
    registry = {"ema": Feature(1, lambda w: F.col("close"), 0.3), "slow": Feature(1, lambda w: F.col("close"), 0.001), "low_12": Feature(12, lambda w: F.min("low").over(w.rowsBetween(-11, 0)), known=3)}
    got = {(r.symbol, r.slot): r for r in feature_table(frame, registry).collect()}
    rows = frame.orderBy("symbol", "slot").collect()
    assert len(got) == len(rows)
    for symbol in ("a", "b"):
        ema = slow = None
        own = [r for r in rows if r.symbol == symbol]
        for i, r in enumerate(own):
            if r.close is not None:
                ema, slow = (r.close, r.close) if ema is None else (ema + 0.3 * (r.close - ema), slow + 0.001 * (r.close - slow))
            at = got[symbol, r.slot]
            assert at.known_at == r.slot + 3 and at.low_12 == min(x.low for x in own[max(0, i - 11) : i + 1])
            assert (at.ema, at.slow) == pytest.approx((ema, slow), abs=2e-6)


def differs(frame, cut, registry):
    """How many rows up to the cut each feature has other values for once the later ones are gone."""
    names = list(registry)
    whole, part = feature_table(frame, registry), feature_table(frame.where(F.col("slot") <= cut), registry)
    both = whole.select("symbol", "slot", F.struct(*names).alias("x")).join(part.select("symbol", "slot", F.struct(*names).alias("y")), ["symbol", "slot"])
    return both.agg(*(F.count_if(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))).alias(c) for c in names)).first().asDict()


def test_no_feature_looks_ahead(bars):
    leaky = {"centred": Feature(1, lambda w: F.lead("close").over(w))}
    counts = differs(bars, 60, features.REGISTRY)
    assert len(counts) == 38 and not any(counts.values())
    assert differs(bars, 60, {**leaky, "ema_6": features.REGISTRY["ema_6"]}) == {"centred": 2, "ema_6": 0}


def test_frames_share_one_shuffle_and_empty_tables_are_empty(bars):
    plan = feature_table(bars)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(symbol#\d+, _chunk#", plan)) == 1  # the others move a row a chunk
    assert feature_table(bars.limit(0)).collect() == []
