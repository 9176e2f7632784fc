"""Quality rules: counts of each text, and a calibrated logistic regression over hashed n-grams.

Features are hashed words, pairs of words, and runs of 4 bytes; each kind's frequencies add up to one in a
text, so a text's score is the mean weight of its n-grams.  The regression is trained in numpy on a bounded
sample of labelled rows; folds 2 to 4 fit the weights and fold 1 calibrates the probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.llm import kernels as K
from tidemark.llm.samples import labelled_sample
from tidemark.llm.shared import through

#: Buckets of each kind of feature, as a power of two.
BITS = 18
#: Labelled rows for training, of each label at most, and their characters in all.
TRAIN_ROWS, TRAIN_CHARS = 1500, 8_000_000
#: A text is kept from this probability of label 1.
KEEP_FROM = 0.5
#: The base rule: fewer words fail, as do texts of which more than this percentage repeats.
LEAST_WORDS, MOST_REPEATED = 50, 50
_SCALE = 40.0
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_BEGINS_CHAR = (np.arange(256) & 0xC0) != 0x80


def features(words: K.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every n-gram of a block, one pair of arrays a kind: words, pairs, runs of 4 bytes."""
    hashes = words.hashes()
    shift = np.uint64(64 - BITS)
    out = [(words.doc, (hashes >> shift).astype(np.int64))]
    pair = K.within(words, 2)
    out.append((words.doc[: len(pair)][pair], (K.ngram_hashes(hashes, 2)[pair] >> shift).astype(np.int64)))
    data = words.data.astype(np.uint32)
    runs = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24) if len(data) > 3 else np.zeros(0, np.uint32)
    doc = np.repeat(np.arange(len(words.begins) - 1), np.diff(words.begins))[: len(runs)]
    inside = np.arange(len(runs)) + 4 < words.begins[doc + 1] if len(runs) else np.zeros(0, bool)
    out.append((doc[inside], ((runs[inside] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)))
    return out


class QualityModel:
    """Weights of each kind of feature, the intercept, and the calibration's slope and offset."""

    def __init__(self):
        self.weights, self.intercept, self.slope, self.offset = np.zeros((3, 1 << BITS), np.float32), 0.0, 1.0, 0.0

    def logits(self, words: K.Words) -> np.ndarray:
        n, out = len(words.begins) - 1, self.intercept
        for weight, (doc, bucket) in zip(self.weights, features(words)):
            out = out + _SCALE * np.bincount(doc, weight[bucket], n) / np.maximum(1, np.bincount(doc, minlength=n))
        return out

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offset, -30, 30)))

    def fit(self, texts: list[str], labels: list[int], folds: list[int], rounds: int = 60) -> QualityModel:
        y, folds = np.array(labels, np.float64), np.array(folds)
        rate = (y.sum() + 1) / (len(y) + 2)
        self.offset = float(np.log(rate / (1 - rate)))
        train = np.flatnonzero(folds != 1)
        if len({*y[train].tolist()}) < 2:
            return self
        rows, columns, values = [], [], []
        for a, z in K.blocks([texts[i] for i in train]):
            for kind, (doc, bucket) in enumerate(features(K.Words([texts[i] for i in train[a:z]], K.NOT_SPACE, False))):
                total = np.bincount(doc, minlength=z - a)
                key, count = np.unique(doc * (1 << BITS) + bucket, return_counts=True)
                rows.append((key >> BITS) + a), columns.append((key & ((1 << BITS) - 1)) + (kind << BITS))
                values.append(_SCALE * count / total[key >> BITS])
        row, column, value = np.concatenate(rows), np.concatenate(columns), np.concatenate(values)
        used, column = np.unique(column, return_inverse=True)
        w, b, target = np.zeros(len(used)), 0.0, y[train]
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        balance = np.where(target == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean()))
        for step in range(1, rounds + 1):
            d = balance * (1 / (1 + np.exp(-np.clip(np.bincount(row, w[column] * value, len(train)) + b, -30, 30))) - target) / len(train)
            g, gb = np.bincount(column, value * d[row], len(used)) + 1e-4 * w, d.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            b -= 0.05 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
        self.weights.reshape(-1)[used], self.intercept = w, float(b)
        self.slope, self.offset = 1.0, 0.0
        rest = np.flatnonzero(folds == 1)
        if len({*y[rest].tolist()}) == 2:
            self._calibrate(np.concatenate([self.logits(K.Words([texts[i] for i in rest[a:z]], K.NOT_SPACE, False)) for a, z in K.blocks([texts[i] for i in rest])]), y[rest])
        return self

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling with smoothed targets, by Newton steps on a slightly regularised loss."""
        up, down = y.sum(), len(y) - y.sum()
        target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
        p = np.array([1.0, 0.0])
        z = np.stack([x, np.ones_like(x)])
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(p @ z, -30, 30)))
            step = np.linalg.solve((z * (q * (1 - q))) @ z.T + 1e-3 * np.eye(2), z @ (q - target) + 1e-3 * (p - [1.0, 0.0]))
            p = p - np.clip(step, -1, 1)
        if p[0] > 0:
            self.slope, self.offset = float(p[0]), float(p[1])


def base_counts(texts: list[str | None], words: K.Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a block."""
    n = len(texts)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[words.begins])
    three, inside = K.ngram_hashes(words.hashes(), 3), K.within(words, 3)
    at = np.flatnonzero(inside)
    keys = K.mix(three[at] ^ (words.doc[at].astype(np.uint64) * K._GOLDEN))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = at[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] if len(at) else at
    repeated = np.zeros(len(words), bool)
    for s in range(3):
        repeated[twice + s] = True
    lines = np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        if text and "\n" in text:
            found = Counter(line for line in text.split("\n") if line.strip(" \t\n\x0b\f\r"))
            lines[i] = found.total() - len(found)
    return {"n_words": words.counts(), "word_chars": sums(K.NOT_SPACE[words.data] & _BEGINS_CHAR[words.data]), "n_symbols": sums(_SYMBOL[words.data]), "n_dup_lines": lines, "n_repeat_words": np.bincount(words.doc, repeated, n).astype(np.int64)}


def _judge(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = model.value
        for batch in batches:
            texts = batch["text"].tolist()
            for a, z in K.blocks(texts):
                words = K.Words(texts[a:z], K.NOT_SPACE, False)
                out = pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[a:z], **base_counts(texts[a:z], words)})
                failed = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
                quality = scorer.probability(scorer.logits(words))
                yield out.assign(base_failed=failed, kept=~failed & (quality >= KEEP_FROM), quality=quality)

    return run


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality) of every
    row of docs(doc_id, text), with the regression trained on labels(doc_id, quality).

    Words end at ASCII white space.  Null and empty texts have no words and fail the base rule.  quality is
    the calibrated probability of label 1; a text that passes the base rule is kept from KEEP_FROM.  Without
    training rows of both labels every text has the smoothed share of label 1.  Repeated rows and null
    doc_ids are kept as given; other columns are ignored.
    """
    rows = labelled_sample(docs, labels, "quality", TRAIN_ROWS, TRAIN_CHARS)
    model = docs.sparkSession.sparkContext.broadcast(QualityModel().fit([r.text for r in rows], [r.label for r in rows], [r.fold for r in rows]))
    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"
    return through(docs.selectExpr("doc_id", "cast(text as string) as text"), _judge(model), "doc_id", schema)
