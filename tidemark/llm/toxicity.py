"""Toxicity: a bidirectional gated recurrent network with attention pooling, over character and word inputs.

A word's input is an embedding of the word itself and the mean of embeddings of its character runs (its first 4 to
6 bytes, and all runs of 4 bytes), from hashed tables.  Both tables and the network are trained in numpy by
back-propagation, through time for the network: first the tables alone, with a linear score of each word and a
smooth maximum over a text, then tables and network together on the windows of each text that score highest.
A text is scored by its highest window: windows of WINDOW words begin every STRIDE words, so that any WINDOW -
STRIDE consecutive words are in one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.samples import held_out, labelled_sample
from tidemark.llm.shared import fresh, lean, small_batches, through

WINDOW, STRIDE, HIDDEN = 32, 16, 8
#: Values of an embedding, and rows of the tables of words and of character runs, as powers of two.
WIDTH, WORD_BITS, RUN_BITS = 8, 18, 17
INPUTS = 2 * WIDTH
#: Labelled rows for training, of each label at most, by hash order; and their characters in all.
TRAIN_ROWS, TRAIN_CHARS = 1200, 5_000_000
#: Windows of a training text that may become its highest.
CANDIDATES = 4
#: Rounds over the training texts: of the tables alone, and with the network.
WARM_ROUNDS, ROUNDS = 8, 10
#: Share of words whose own embedding is left out in a training step, so that their characters learn too.
DROPPED = 0.3
#: Step sizes, and the share by which what is moved shrinks at each step.
WARM_RATE, RATE, DECAY = 0.02, 0.005, 1e-3
#: Label 1, where it is rarer, counts up to so many times as much.
RARE = 1.5
#: Words that a worker remembers before it starts anew, and windows that it scores at once.
MEMO, SCORED = 1 << 15, 512
_KINDS = {"word": np.uint64(0x51), "head": np.uint64(0x52), "inner": np.uint64(0x53)}


def runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the word table for each word, word index and row of the run table for each character run)."""
    spans, n = K.SpanHash(data), end - start
    index, value = [], []
    for size in (4, 5, 6):
        has = np.flatnonzero(n >= size)
        index.append(has)
        value.append(K.mix(spans(start[has], start[has] + size) ^ _KINDS["head"]))
    count = np.maximum(n - 3, 1)
    word = np.repeat(np.arange(len(start)), count)
    at = start[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    index.append(word)
    value.append(K.mix(spans(at, np.minimum(at + 4, end[word])) ^ _KINDS["inner"]))
    own = K.mix(spans(start, end) ^ _KINDS["word"]) >> np.uint64(64 - WORD_BITS)
    return own.astype(np.int64), np.concatenate(index), (np.concatenate(value) >> np.uint64(64 - RUN_BITS)).astype(np.int64)


class Lookup:
    """The inputs of a block's distinct words, and the way back from their gradients to the tables."""

    def __init__(self, own: np.ndarray, index: np.ndarray, run: np.ndarray):
        order = np.argsort(index, kind="stable")
        self.own, self.run, self.index = own, run[order], index[order]
        self.begin = np.searchsorted(self.index, np.arange(len(own)))
        self.share = (1 / np.bincount(self.index, minlength=len(own)))[:, None]

    def inputs(self, words: np.ndarray, runs: np.ndarray, kept: np.ndarray | float = 1.0) -> np.ndarray:
        if not len(self.own):
            return np.zeros((0, INPUTS), words.dtype)
        return np.concatenate([words[self.own] * kept, np.add.reduceat(runs[self.run], self.begin) * self.share.astype(runs.dtype)], 1)

    def back(self, slope: np.ndarray, kept: np.ndarray | float) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """(rows, gradients) of both tables, from the gradients of the inputs."""
        out = {}
        for name, row, part in (("words", self.own, slope[:, :WIDTH] * kept), ("runs", self.run, (slope[:, WIDTH:] * self.share)[self.index])):
            rows, at = np.unique(row, return_inverse=True)
            out[name] = rows, np.stack([np.bincount(at, part[:, i], len(rows)) for i in range(WIDTH)], 1)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_network(seed: int = 7) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    out = {}
    for way in "fb":
        out["W" + way] = draw.normal(0, 0.25, (INPUTS, 3 * HIDDEN))
        out["b" + way] = np.zeros(3 * HIDDEN)
        out["U" + way] = draw.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
    return out | {"A": draw.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "a": np.zeros(HIDDEN), "v": draw.normal(0, 0.5, HIDDEN), "w": draw.normal(0, 0.3, 2 * HIDDEN), "o": np.zeros(1)}


def _gru(gates, U, mask, kept=None):
    """gates: (steps, windows, 3 H), inputs already projected; mask: (steps, windows, 1)."""
    h = np.zeros((gates.shape[1], HIDDEN), gates.dtype)
    out = np.empty((len(gates), *h.shape), gates.dtype)
    for t in range(len(gates)):
        zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + h @ U[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN] * mask[t], zr[:, HIDDEN:]
        c = np.tanh(gates[t, :, 2 * HIDDEN :] + (r * h) @ U[:, 2 * HIDDEN :])
        if kept is not None:
            kept.append((h, zr[:, :HIDDEN], r, c))
        h = h + z * (c - h)
        out[t] = h
    return out


def forward(net, forth, back, mask, kept=None):
    """Logit of each window, from the projected inputs of both directions."""
    keep_f, keep_b = ([], []) if kept is not None else (None, None)
    hf = _gru(forth, net["Uf"], mask, keep_f)
    hb = _gru(back[::-1], net["Ub"], mask[::-1], keep_b)[::-1]
    h = np.concatenate([hf, hb], 2)
    s = np.tanh(h @ net["A"] + net["a"])
    e = np.where(mask[..., 0] > 0, s @ net["v"], -1e9)
    e = np.exp(e - e.max(0))
    weight = e / e.sum(0)
    pooled = np.einsum("tn,tnh->nh", weight, h)
    if kept is not None:
        kept.update(f=keep_f, b=keep_b, h=h, s=s, weight=weight, pooled=pooled)
    return pooled @ net["w"] + net["o"][0]


def _gru_back(net, way, x, mask, kept, dh_out, grad):
    U, dU, dnext = net["U" + way], grad["U" + way], np.zeros_like(kept[0][0])
    dg = np.empty((len(x), x.shape[1], 3 * HIDDEN))
    for t in reversed(range(len(x))):
        h, z, r, c = kept[t]
        dh = dh_out[t] + dnext
        zm = z * mask[t]
        dc = dh * zm * (1 - c * c)
        dz = dh * (c - h) * mask[t] * z * (1 - z)
        drh = dc @ U[:, 2 * HIDDEN :].T
        dr = drh * h * r * (1 - r)
        dg[t] = np.concatenate([dz, dr, dc], 1)
        dU[:, : 2 * HIDDEN] += h.T @ dg[t][:, : 2 * HIDDEN]
        dU[:, 2 * HIDDEN :] += (r * h).T @ dc
        dnext = dh * (1 - zm) + drh * r + dg[t][:, : 2 * HIDDEN] @ U[:, : 2 * HIDDEN].T
    grad["W" + way] += np.einsum("tni,tng->ig", x, dg)
    grad["b" + way] += dg.sum((0, 1))
    return dg @ net["W" + way].T


def gradients(net, x, mask, dlogit_of):
    """(logits, gradients, those of x); dlogit_of maps logits to the loss's derivative by them.  x: (steps, windows, inputs)."""
    kept: dict = {}
    logits = forward(net, x @ net["Wf"] + net["bf"], x @ net["Wb"] + net["bb"], mask, kept)
    d = dlogit_of(logits)
    grad = {k: np.zeros_like(v) for k, v in net.items()}
    grad["o"][0], grad["w"] = d.sum(), kept["pooled"].T @ d
    dpool = d[:, None] * net["w"]
    dh = kept["weight"][..., None] * dpool
    dweight = np.einsum("tnh,nh->tn", kept["h"], dpool)
    de = kept["weight"] * (dweight - (kept["weight"] * dweight).sum(0))
    grad["v"] = np.einsum("tn,tnk->k", de, kept["s"])
    ds = de[..., None] * net["v"] * (1 - kept["s"] ** 2)
    grad["A"], grad["a"] = np.einsum("tnh,tnk->hk", kept["h"], ds), ds.sum((0, 1))
    dh = dh + ds @ net["A"].T
    dx = _gru_back(net, "f", x, mask, kept["f"], dh[..., :HIDDEN], grad)
    dx = dx + _gru_back(net, "b", x[::-1], mask[::-1], kept["b"], dh[::-1][..., HIDDEN:], grad)[::-1]
    return logits, grad, dx


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word within it) of every window; the last one reaches the text's end."""
    n = np.where(counts > WINDOW, (counts - WINDOW + STRIDE - 1) // STRIDE + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(counts)), n)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE


def _steps(first: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word index (steps, windows) and mask of windows; first: first word of each text, and the total."""
    index = (first[text] + at)[None, :] + np.arange(WINDOW)[:, None]
    mask = index < first[text + 1][None, :]
    return np.where(mask, index, 0), mask[..., None].astype(np.float32)


class Adam:
    """Steps of the parameters by their gradients; of a table only the rows that have any are moved."""

    def __init__(self, values: dict[str, np.ndarray]):
        self.values, self.moments, self.step = values, {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in values.items()}, 0

    def move(self, slopes: dict, rate: float, decay: float) -> None:
        self.step += 1
        for k, g in slopes.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            m, v, x = (array[at] for array in (*self.moments[k], self.values[k]))
            m, v = m + 0.1 * (g - m), v + 0.01 * (g * g - v)
            self.moments[k][0][at], self.moments[k][1][at] = m, v
            self.values[k][at] = x - rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-8) - decay * x


class ToxicityModel:
    """The trained tables and network; small, and sent to the tasks whole."""

    def __init__(self):
        self.prior, self.net, self.shift = 0.0, None, 0.0
        self.words, self.runs = np.zeros((1 << WORD_BITS, WIDTH), np.float32), np.zeros((1 << RUN_BITS, WIDTH), np.float32)

    def fit(self, texts: list[str | None], labels: list[int]) -> ToxicityModel:
        y = np.array(labels, np.int64)
        self.prior = float(y.mean()) if len(y) else 0.0
        if len({*labels}) < 2:
            return self
        # Distinct words of all texts; the words of each text by their index among these
        keys, spans, words, counts = [], [], [], []
        for a, z in K.blocks(texts):
            block = K.Words(texts[a:z], K.ALNUM, True)
            distinct, one, place = K.distinct(block.hashes())
            keys.append(distinct), spans.append(runs(block.data, block.start[one], block.end[one]))
            words.append(distinct[place]), counts.append(block.counts())
        known, first = np.unique(np.concatenate(keys), return_index=True)
        owner = np.concatenate([np.full(len(k), i) for i, k in enumerate(keys)])[first]
        place = first - np.concatenate([[0], np.cumsum([len(k) for k in keys])])[owner]
        own, index, run = np.zeros(len(known), np.int64), [], []
        for i, (o, x, r) in enumerate(spans):
            mine = np.flatnonzero(owner == i)
            own[mine] = o[place[mine]]
            back = np.full(len(o), -1)
            back[place[mine]] = mine
            keep = back[x] >= 0
            index.append(back[x[keep]]), run.append(r[keep])
        self.lookup = own, np.concatenate(index), np.concatenate(run)
        order = np.argsort(self.lookup[1], kind="stable")
        self.lookup = own, self.lookup[1][order], self.lookup[2][order]
        self.reach = np.searchsorted(self.lookup[1], np.arange(len(known) + 1))
        word = np.searchsorted(known, np.concatenate(words))
        count = np.concatenate(counts)
        draw = np.random.default_rng(11)
        self.words, self.runs = draw.normal(0, 0.05, self.words.shape), draw.normal(0, 0.05, self.runs.shape)
        score = self._warm(word, count, y, draw)
        text, at = windows(count)
        edges = np.concatenate([[0], np.cumsum(count)])
        steps, mask = _steps(edges, text, at)
        of_word = np.where(mask[..., 0] > 0, score[word[steps]], -9.0)
        order = np.lexsort((-of_word.max(0) - 0.1 * np.where(mask[..., 0] > 0, of_word, 0).sum(0), text))
        chosen = order[np.arange(len(order)) - np.searchsorted(text[order], text[order]) < CANDIDATES]
        self._train(word[steps[:, chosen]], mask[:, chosen].astype(np.float64), text[chosen], y, draw)
        del self.lookup, self.reach, self.common
        return self

    def _some(self, word: np.ndarray) -> tuple[np.ndarray, Lookup, np.ndarray]:
        """(places of the words among their distinct ones, the lookup of these, which have an embedding of their own)."""
        distinct, place = np.unique(word, return_inverse=True)
        own, _, run = self.lookup
        n = self.reach[distinct + 1] - self.reach[distinct]
        at = np.repeat(self.reach[distinct] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return place.reshape(word.shape), Lookup(own[distinct], np.repeat(np.arange(len(distinct)), n), run[at]), self.common[distinct][:, None].astype(np.float64)

    def _warm(self, word: np.ndarray, count: np.ndarray, y: np.ndarray, draw) -> np.ndarray:
        """Trains the tables with a linear score of words; returns the score of each."""
        edges = np.concatenate([[0], np.cumsum(count)])
        each = [np.unique(word[a:z]) for a, z in zip(edges, edges[1:])]
        # a word of one text alone has only its characters, as unseen words do
        self.common = np.bincount(np.concatenate(each), minlength=len(self.lookup[0])) > 1
        head = {"words": self.words, "runs": self.runs, "u": draw.normal(0, 0.5, INPUTS), "c": np.zeros(1)}
        adam, texts = Adam(head), np.flatnonzero(count > 0)
        weight = np.where(y == 1, np.clip((y == 0).sum() / max(1, y.sum()), 1, RARE), 1.0)
        for turn in range(WARM_ROUNDS):
            for part in np.array_split(draw.permutation(texts), max(1, len(texts) // 64)):
                n = np.array([len(each[i]) for i in part])
                begin = np.cumsum(n) - n
                place, lookup, common = self._some(np.concatenate([each[i] for i in part]))
                kept = common * (draw.random(common.shape) >= DROPPED)
                x = lookup.inputs(self.words, self.runs, kept)
                s = (x @ head["u"])[place]
                top = np.repeat(np.maximum.reduceat(s, begin), n)
                e = np.exp(s - top)
                total = np.add.reduceat(e, begin)
                logit = np.log(total) + top[begin] - np.log(n) + head["c"][0]
                d = weight[part] * (_sigmoid(logit) - y[part]) / len(part)
                ds = np.bincount(place, np.repeat(d / total, n) * e, len(lookup.own))
                adam.move(lookup.back(ds[:, None] * head["u"], kept) | {"u": x.T @ ds, "c": np.array([d.sum()])}, WARM_RATE, DECAY)
        out = np.zeros(len(self.lookup[0]))
        for part in np.array_split(np.arange(len(out)), max(1, len(out) // 65536)):
            _, lookup, common = self._some(part)
            out[part] = lookup.inputs(self.words, self.runs, common) @ head["u"]
        return out

    def _train(self, word, mask, owner, y, draw) -> None:
        self.net = new_network()
        values = {**self.net, "words": self.words, "runs": self.runs}
        adam, texts = Adam(values), np.unique(owner)
        begin = np.searchsorted(owner, texts)
        final = np.full(len(texts), -9.0)
        weight = np.where(y[texts] == 1, np.clip((y[texts] == 0).sum() / max(1, y[texts].sum()), 1, RARE), 1.0)
        for turn in range(ROUNDS):
            for part in np.array_split(draw.permutation(len(texts)), max(1, len(texts) // 64)):
                size = np.append(begin, len(owner))[part + 1] - begin[part]
                at = np.concatenate([np.arange(b, b + s) for b, s in zip(begin[part], size)])
                edge = np.cumsum(size) - size

                def slope(logits):
                    d = np.zeros_like(logits)
                    for i, s, t in zip(edge, size, part):
                        top = i + int(np.argmax(logits[i : i + s]))
                        final[t] = logits[top]
                        d[top] = weight[t] * (_sigmoid(logits[top]) - y[texts[t]]) / len(part)
                    return d

                place, lookup, common = self._some(word[:, at])
                kept = common * (draw.random(common.shape) >= DROPPED)
                x = lookup.inputs(self.words, self.runs, kept)[place] * mask[:, at]
                _, slopes, dx = gradients(self.net, x, mask[:, at], slope)
                dx *= mask[:, at]
                flat = np.stack([np.bincount(place.ravel(), dx[..., i].ravel(), len(lookup.own)) for i in range(INPUTS)], 1)
                adam.move(slopes | lookup.back(flat, kept), RATE * (1 - 0.8 * turn / ROUNDS), DECAY)
        # 0.5 becomes the threshold of least weighted training error
        order = np.argsort(final)
        clean = float((y[texts] == 0).sum())
        wrong = np.append(clean, clean + np.cumsum(np.where(y[texts][order] == 0, -1.0, weight[order])))
        best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
        ends = np.concatenate([[final[order[0]] - 2], final[order], [final[order[-1]] + 2]])
        middle = best[len(best) // 2]
        self.shift = float(np.clip((ends[middle] + ends[middle + 1]) / 2, -3, 3))
        # rows that no window moved say nothing
        self.words, self.runs = (np.where(adam.moments[k][1] > 0, values[k], 0).astype(np.float32) for k in ("words", "runs"))
        self.net = {k: v.astype(np.float32) for k, v in self.net.items()}

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores whole texts; remembers the projected inputs of words."""

    def __init__(self, model: ToxicityModel):
        self.model, self.slots, self.table = model, {}, np.zeros((1024, 6 * HIDDEN), np.float32)

    def _slots(self, words: K.Words) -> np.ndarray:
        keys, one, place = K.distinct(words.hashes())
        if len(self.slots) > MEMO:
            self.slots = {}
        listed = keys.tolist()
        new = [j for j, key in enumerate(listed) if key not in self.slots]
        if new:
            model, have = self.model, len(self.slots)
            x = Lookup(*runs(words.data, words.start[one[new]], words.end[one[new]])).inputs(model.words, model.runs)
            if have + len(new) > len(self.table):
                self.table = np.resize(self.table, (have + len(new) + (have + len(new)) // 4, 6 * HIDDEN))
            self.table[have : have + len(new)] = np.concatenate([x @ model.net["Wf"] + model.net["bf"], x @ model.net["Wb"] + model.net["bb"]], 1)
            self.slots.update(zip((listed[j] for j in new), range(have, have + len(new))))
        return np.fromiter(map(self.slots.__getitem__, listed), np.int64, len(listed))[place]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.model.prior if self.model.net is None else 0.0)
        if self.model.net is None:
            return out
        words = K.Words(texts, K.ALNUM, True)
        if not len(words):
            return out
        slots = self._slots(words)
        text, at = windows(words.counts())
        best = np.full(len(texts), -np.inf)
        for a in range(0, len(text), SCORED):
            steps, mask = _steps(words.first, text[a : a + SCORED], at[a : a + SCORED])
            gates = self.table[slots[steps]]
            np.maximum.at(best, text[a : a + SCORED], forward(self.model.net, gates[..., : 3 * HIDDEN], gates[..., 3 * HIDDEN :], mask))
        return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best - self.model.shift, -30, 30))), out)


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Train on at most TRAIN_ROWS rows of each label and TRAIN_CHARS characters; see ``labelled_sample``."""
    rows = labelled_sample(docs, labels, "toxic", TRAIN_ROWS, TRAIN_CHARS)
    return ToxicityModel().fit([r.text for r in rows], [r.label for r in rows])


def _score(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model.value.scorer()
        for batch in batches:
            texts = batch["text"].tolist()
            found = [score(texts[a:z]) for a, z in K.blocks(texts)]
            yield batch.drop(columns="text").assign(score=np.concatenate(found) if found else np.zeros(0))

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text), trained on labels(doc_id, toxic).

    Only rows that are not held out train.  Labels that are null or neither 0 nor 1 and texts that are null or
    longer than 1,000,000 characters don't train; equal texts train once.  Every text is scored whole; one
    without words, null or empty, scores 0.  Without labels of both kinds every score is the share of label 1.
    predicted is 1 from a score of 0.5.  A null doc_id counts as held out.  Repeated rows are kept.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = through(docs, _score(model), "doc_id", "score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs whose text scores below 0.5; see ``toxicity_scores``.  All columns stay as they are, repeated
    rows too; a null text has no words and stays.  Without labels of both kinds all rows stay, or none do where
    half or more of the labels are 1."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels))

    @F.pandas_udf("double")
    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def scores(series):
            scorer = model.value.scorer()
            for texts in series:
                listed = texts.tolist()
                yield pd.Series([x for a, z in K.blocks(listed) for x in scorer(listed[a:z])], dtype=float)

        return lean(scores)(series)

    name = fresh(docs, "_score")
    return docs.withColumn(name, score(F.col("text").cast("string"))).where(F.col(name) < 0.5).select(docs.columns)
