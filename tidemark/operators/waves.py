"""Directional-change waves.

The state after a bar (direction and running extreme) depends on all bars before, so bars are folded in chunks that first
tell what they do to any state.  With a direction and an extreme at its start, a chunk either reaches a reversal of
that extreme, or one of its own, or none; the stronger the extreme, the sooner.  So a chunk is a step function of the
extreme for either direction: few bounds, each with the state in which the chunk then ends, and at last either such a state
or the extreme that stays if none was stronger.  Such functions compose, so a scan over the chunks gives each its true state at the
start, whatever the threshold.

Until the first change both extremes run; they are the running maximum and minimum, which need no composition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import states_before
from tidemark.operators.series import indexed, windowed
from tidemark.plans.tables import settle

#: Bars of a chunk, and bars that are looked at one by one for the next change.
CHUNK, NEAR = 4096, 64
_CHANGE = "direction int, extreme_slot long, extreme double, confirm_slot long, confirm double"
_NAMES = [c.split()[0] for c in _CHANGE.split(", ")]
_PARTS = "symbol string, theta double, chunk long, high double, high_at long, low double, low_at long, f array<double>, first_down array<double>, first_up array<double>"
_STATE = "direction int, extreme double, at long"
_EXTREMES = ["entry_high", "entry_high_at", "entry_low", "entry_low_at"]


def fold(state: tuple | None, slots, closes, reversals) -> tuple[tuple | None, list[tuple]]:
    """(state, changes) after bars in order.  A state is (direction, high, its slot, low, its slot), with None for the
    extreme that doesn't matter; before the first bar there is none, and until the first change the direction is 0."""
    out = []
    for slot, close, reversal in zip(slots, closes, reversals):
        if state is None:
            state = (0, close, slot, close, slot)
            continue
        up, hi, hi_at, lo, lo_at = state
        if up >= 0 and close > hi:
            hi, hi_at = close, slot
        if up <= 0 and close < lo:
            lo, lo_at = close, slot
        if up <= 0 and lo_at != slot and close >= lo * (1 + reversal):
            out.append((1, lo_at, lo, slot, close))
            state = (1, close, slot, None, None)
        elif up >= 0 and hi_at != slot and close <= hi * (1 - reversal):
            out.append((-1, hi_at, hi, slot, close))
            state = (-1, None, None, close, slot)
        else:
            state = (up, hi, hi_at, lo, lo_at)
    return state, out


def _confirms(direction: int, close, extreme, reversal):
    return close <= extreme * (1 - reversal) if direction > 0 else close >= extreme * (1 + reversal)


def _bound(direction: int, close: float, reversal: float) -> float:
    """The weakest extreme, times the direction, that ``close`` reverses; infinite if none."""
    scale = 1 - direction * reversal
    if not scale > 0:
        return math.inf
    x = close / scale  # off by its rounding at most
    while _confirms(direction, close, weaker := math.nextafter(x, -direction * math.inf), reversal):
        x = weaker
    while not _confirms(direction, close, x, reversal):
        x = math.nextafter(x, direction * math.inf)
    return direction * x


class _Chunk:
    """Bars of a chunk, in order; a state is (direction, extreme, its slot)."""

    def __init__(self, slots, closes, reversals):
        self.slots, self.closes, self.reversals = slots, closes, reversals
        self.bars = list(zip(closes.tolist(), reversals.tolist()))
        self.known: dict[tuple[int, int], tuple] = {}

    def reversals_of(self, direction: int) -> tuple[int, list[tuple[float, int]]]:
        """(bar at which the chunk's own extreme is reversed, if any, [(bound, bar)]): at or above a bound, the state at
        the start is reversed at its bar; bounds fall with time."""
        with np.errstate(invalid="ignore", divide="ignore"):
            signed = direction * self.closes
            top = np.maximum.accumulate(signed)
            fresh = np.append(True, signed[1:] > top[:-1])
            own = ~fresh & _confirms(direction, self.closes, direction * top, self.reversals)
            free = int(own.argmax()) if own.any() else len(signed)
            scale = 1 - direction * self.reversals[:free]
            about = np.where(scale > 0, signed[:free] / scale, np.inf)
            least = np.append(np.inf, np.minimum.accumulate(about)[:-1]) if free else about
            near = np.flatnonzero((about < np.inf) & (about - np.abs(about) * 1e-9 <= least))
        bounds, last = [], math.inf
        for bar in near.tolist():
            if (bound := _bound(direction, *self.bars[bar])) < last:
                bounds.append((bound, bar))
                last = bound
        return free, bounds

    def _next(self, bar: int, direction: int) -> tuple[int | None, tuple]:
        """The bar of the change that follows one to ``direction`` at ``bar``, if any, and else the state at the end."""
        extreme, at, near = self.bars[bar][0], bar, min(len(self.bars), bar + 1 + NEAR)
        for i in range(bar + 1, near):
            close, reversal = self.bars[i]
            if direction * close > direction * extreme:
                extreme, at = close, i
            elif _confirms(direction, close, extreme, reversal):
                return i, ()
        if near < len(self.bars):
            signed = direction * self.closes[near:]
            top = np.maximum.accumulate(np.append(direction * extreme, signed))
            own = (signed <= top[:-1]) & _confirms(direction, self.closes[near:], direction * top[1:], self.reversals[near:])
            if own.any():
                return near + int(own.argmax()), ()
            if top[-1] > direction * extreme:
                extreme, at = float(direction * top[-1]), near + int(signed.argmax())
        return None, (direction, extreme, int(self.slots[at]))

    def end(self, bar: int, direction: int) -> tuple:
        """The state at the end after a change to ``direction`` at ``bar``; changes that meet go on together."""
        path = []
        while (bar, direction) not in self.known:
            path.append((bar, direction))
            following, state = self._next(bar, direction)
            if following is None:
                self.known[bar, direction] = state
            else:
                bar, direction = following, -direction
        for step in path:
            self.known[step] = self.known[bar, direction]
        return self.known[bar, direction]


def _put(pieces: list[tuple], bound: float, state: tuple) -> None:
    """Adds a piece to a step function; pieces (bound, direction, extreme, slot) come by falling bounds, the last one minus
    infinity.  A direction of 0 keeps the state, with the stronger extreme."""
    if pieces and state[0] and pieces[-1][1:] == state:
        pieces[-1] = (bound, *state)
    else:
        pieces.append((bound, *state))


def _summary(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A chunk's extremes, its step functions, and how it ends after a first change, by the extremes before."""
    rows = rows.sort_values("slot", kind="stable")
    chunk = _Chunk(rows["slot"].to_numpy(), rows["close"].to_numpy(), rows["reversal"].to_numpy())
    found = {d: chunk.reversals_of(d) for d in (1, -1)}
    until = min(free for free, _ in found.values())
    functions, firsts, extremes = [], [], []
    for d, (free, bounds) in found.items():
        pieces, first = [], []
        at = int((d * chunk.closes).argmax())
        extremes += [float(chunk.closes[at]), int(chunk.slots[at])]
        for bound, bar in bounds:
            _put(pieces, bound, state := chunk.end(bar, -d))
            first += [bound, bar, *state] if bar <= until else []
        if free < len(rows):
            _put(pieces, -math.inf, state := chunk.end(free, -d))
            first += [-math.inf, free, *state] if free <= until else []
        else:
            _put(pieces, -math.inf, (0, *extremes[-2:]))
        functions.append(pieces)
        firsts.append([float(x) for x in first])
    return pd.DataFrame([(*key, *extremes, _flat(functions), *firsts)], columns=[c.split()[0] for c in _PARTS.split(", ")])


def _begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks that would hold a symbol's first change, with the state in which they then end."""
    for batch in batches:
        out = []
        for symbol, theta, chunk, high, high_at, low, low_at, *firsts in batch[["symbol", "theta", "chunk", *_EXTREMES, "first_up", "first_down"]].itertuples(index=False):
            best = None
            for extreme, flat in zip((-low, high), firsts):  # a bar that reverses both counts as up
                for bound, bar, *state in np.reshape(flat, (-1, 5)):
                    if bound == -math.inf or extreme >= bound:
                        best = min(best or (math.inf,), (bar, *state), key=lambda x: x[0])
                        break
            if best:
                out.append((symbol, theta, chunk, int(best[1]), best[2], int(best[3]), high, high_at, low, low_at))
        yield pd.DataFrame(out, columns=["symbol", "theta", "chunk", *(c.split()[0] for c in _STATE.split(", ")), *_EXTREMES]).astype({"entry_high_at": "Int64", "entry_low_at": "Int64"})


def _pieces(flat) -> tuple[list[tuple], list[tuple]]:
    """The step functions of both directions, of which the first is as long as the array's first number says."""
    pieces = [(bound, int(direction), extreme, int(at)) for bound, direction, extreme, at in np.reshape(flat[1:], (-1, 4)).tolist()]
    return pieces[: int(flat[0])], pieces[int(flat[0]) :]


def _flat(functions: tuple[list, list]) -> list[float]:
    return [float(len(functions[0])), *(float(x) for pieces in functions for piece in pieces for x in piece)]


def _after(functions: tuple[list, list], state: tuple | None) -> tuple:
    """The state after a chunk; with none before, what the chunk ends in for any."""
    if state is None:
        return functions[0][-1][1:]
    direction, extreme, _ = state
    for bound, *end in functions[0 if direction > 0 else 1]:
        if direction * extreme >= bound:
            if end[0]:
                return tuple(end)
            return (direction, *end[1:]) if direction * end[1] > direction * extreme else state


def _compose(first: tuple[list, list], second: tuple[list, list]) -> tuple[list, list]:
    """The step functions of two chunks, one after the other."""
    out = []
    for d, pieces, others in zip((1, -1), first, second):
        both = []
        for bound, *end in pieces:
            if end[0]:
                _put(both, bound, _after(second, tuple(end)))
                continue
            for other, *after in others:  # the extreme is the state's or this chunk's
                after = tuple(after) if after[0] or d * after[1] > d * end[1] else tuple(end)
                if d * end[1] >= other:
                    _put(both, -math.inf, after)
                    break
                if not both or other < both[-1][0]:
                    _put(both, other, after)
        out.append(both)
    return out[0], out[1]


def _composed(first, second) -> list[float]:
    return _flat(_compose(_pieces(first), _pieces(second)))


def _state_after(flat, state) -> list[float]:
    return [float(x) for x in _after(_pieces(flat), None if state is None else (int(state[0]), float(state[1]), int(state[2])))]


def _fold_chunk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The changes of one chunk from the state before it."""
    rows = rows.sort_values("slot", kind="stable")
    first = rows.iloc[0]
    state = None
    if not pd.isna(first["dir"]):
        state = tuple(None if pd.isna(first[c]) else kind(first[c]) for c, kind in (("dir", int), ("hi", float), ("hi_at", int), ("lo", float), ("lo_at", int)))
    _, changes = fold(state, rows["slot"].tolist(), rows["close"].tolist(), rows["reversal"].tolist())
    return pd.DataFrame([(*key[:2], *change) for change in changes], columns=["symbol", "theta", *_NAMES])


def directional_changes(bars: DataFrame, thetas: list[float], unit: str | None = None) -> DataFrame:
    """(symbol, theta, direction, extreme_slot, extreme, confirm_slot, confirm): a change is confirmed at the first
    close that reverses by theta from the running extreme, and may be used from then on only.

    ``unit``: a column of bars that scales theta at each bar, as a relative sigma known before it; where it is null
    the bar confirms nothing.  Until the first change both extremes run; a close that would confirm both ways
    counts as up.  Closes are positive; bars without one are passed over.  Bars are read twice, whatever the thresholds."""
    rows = bars.select("symbol", "slot", F.col("close").cast("double").alias("close"), (F.col(unit).cast("double") if unit else F.lit(1.0)).alias("unit"), F.timestamp_seconds(F.col("slot") * 3600).alias("t"))
    scales = F.explode(F.array(*(F.lit(x).cast("double") for x in thetas))).alias("theta")
    rows = indexed(rows.where("close IS NOT NULL AND NOT isnan(close)")).select("symbol", "slot", "close", "unit", F.floor(F.col("idx") / CHUNK).alias("chunk"), scales)
    rows = settle(rows.select("symbol", "theta", "chunk", "slot", "close", F.coalesce(F.col("theta") * F.col("unit"), F.lit(float("nan"))).alias("reversal")), "steps")
    key = ["symbol", "theta", "chunk"]
    parts = settle(rows.groupBy(*key).applyInPandas(_summary, _PARTS), "chunks")
    before = Window.partitionBy("symbol", "theta").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    high, low = F.max(F.struct("high", (-F.col("high_at")).alias("at"))).over(before), F.min(F.struct("low", "low_at")).over(before)
    known = parts.withColumn("h", high).withColumn("l", low)
    extremes = {"entry_high": F.coalesce("h.high", F.lit(-math.inf)), "entry_high_at": -F.col("h.at"), "entry_low": F.coalesce("l.low", F.lit(math.inf)), "entry_low_at": F.col("l.low_at")}
    begun = known.withColumns(extremes).select(*key, "first_up", "first_down", *extremes).mapInPandas(_begin, f"symbol string, theta double, chunk long, {_STATE}, entry_high double, entry_high_at long, entry_low double, entry_low_at long")
    state = F.struct(F.col("chunk").alias("begin"), F.col("direction").cast("double").alias("d"), F.col("extreme").alias("x"), F.col("at").cast("double").alias("s"), *extremes)
    starts = settle(begun.groupBy("symbol", "theta").agg(F.min_by(state, "chunk").alias("b")).select("symbol", "theta", "b.*"), "starts")
    piece = [F.lit(-math.inf), F.col("d"), F.col("x"), F.col("s")]
    function = F.when(F.col("chunk") == F.col("begin"), F.array(F.lit(1.0), *piece, *piece)).otherwise(F.col("f")).alias("f")
    live = parts.join(starts, ["symbol", "theta"]).where("chunk >= begin")
    last = parts.agg(F.max("chunk")).first()[0] or 0
    entries = states_before(live.select("symbol", "theta", F.col("chunk").alias("place"), function), ["symbol", "theta"], last, _composed, _state_after).where("state IS NOT NULL")
    up = F.col("state")[0] > 0
    extreme, at = F.col("state")[1], F.col("state")[2].cast("long")
    inside = entries.select("symbol", "theta", F.col("place").alias("chunk"), F.col("state")[0].cast("int").alias("dir"), F.when(up, extreme).alias("hi"), F.when(up, at).alias("hi_at"), F.when(~up, extreme).alias("lo"), F.when(~up, at).alias("lo_at"))
    some = F.when(F.col("begin") > 0, F.lit(0)).alias("dir")
    first = starts.select("symbol", "theta", F.col("begin").alias("chunk"), some, F.col("entry_high").alias("hi"), F.col("entry_high_at").alias("hi_at"), F.col("entry_low").alias("lo"), F.col("entry_low_at").alias("lo_at"))
    found = rows.join(inside.unionByName(first), key).groupBy(*key).applyInPandas(_fold_chunk, f"symbol string, theta double, {_CHANGE}")
    return settle(found, "changes")


def _by_wave(frame: DataFrame, slot: str, columns: dict, before: int, after: int = 0) -> DataFrame:
    """frame with columns from an ordered window of each symbol and scale, in chunks."""
    named = frame.withColumn("_wave", F.concat_ws("/", "symbol", F.col("theta").cast("string"))).withColumn("_t", F.timestamp_seconds(F.col(slot) * 3600))
    return windowed(named, columns, before, after, "_wave", "_t").drop("_wave", "_t")


def segments(changes: DataFrame) -> DataFrame:
    """Waves between extremes that follow each other: direction, both ends, length and relative amplitude."""
    following = {"next_slot": lambda w: F.lead("extreme_slot").over(w), "next_extreme": lambda w: F.lead("extreme").over(w)}
    out = _by_wave(changes, "confirm_slot", following, 0, 1).where("next_slot IS NOT NULL")
    return out.select("symbol", "theta", "direction", F.col("extreme_slot").alias("start_slot"), F.col("next_slot").alias("end_slot"), (F.col("next_slot") - F.col("extreme_slot")).alias("bars"), F.round(F.col("next_extreme") / F.col("extreme") - 1, 9).alias("amplitude"))


def pullbacks(small: DataFrame, large: DataFrame) -> DataFrame:
    """Waves of ``small`` inside a wave of ``large`` of the other direction; both as from ``segments``."""
    big = large.select("symbol", F.col("direction").alias("large_direction"), F.col("start_slot").alias("large_start"), F.col("end_slot").alias("large_end"))
    # A wave meets few days, so it is dealt to each of them and joined by day
    days = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 24), F.floor(F.col(b) / 24))).alias("day")
    inside = small.withColumn("day", F.floor(F.col("start_slot") / 24)).join(big.select("*", days("large_start", "large_end")), ["symbol", "day"])
    return inside.where("direction = -large_direction AND start_slot >= large_start AND end_slot <= large_end").drop("day")


def wave_statistics(waves: DataFrame) -> DataFrame:
    return waves.groupBy("symbol", "theta", "direction").agg(F.count("*").alias("waves"), F.round(F.avg("amplitude"), 6).alias("mean_amplitude"), F.round(F.avg("bars"), 6).alias("mean_bars"), F.max("bars").alias("longest"))


def with_retracement(waves: DataFrame) -> DataFrame:
    """Waves with their speed (amplitude a bar), and how much of the wave before they take back."""
    speed = F.round(F.col("amplitude") / F.col("bars"), 9)
    return _by_wave(waves.withColumn("speed", speed), "start_slot", {"retracement": lambda w: F.round(F.abs(F.col("amplitude") / F.lag("amplitude").over(w)), 6)}, 1)


def transitions(waves: DataFrame, state) -> DataFrame:
    """(symbol, theta, before, after, waves, share): how often a wave of one state follows one of another."""
    pairs = _by_wave(waves.withColumn("after", state), "start_slot", {"before": lambda w: F.lag("after").over(w)}, 1).where("before IS NOT NULL")
    counts = pairs.groupBy("symbol", "theta", "before", "after").agg(F.count("*").alias("waves"))
    total = F.sum("waves").over(Window.partitionBy("symbol", "theta", "before"))  # a few states
    return counts.withColumn("share", F.round(F.col("waves") / total, 6))
