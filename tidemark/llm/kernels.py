"""Vectorised text kernels shared by the operators: word spans, span hashes and
n-gram hashes over a bounded block of texts.  They run inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Text bytes handled at once; a text longer than this forms a block of its own.
BLOCK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(_BASE)
_powers: dict[int, np.ndarray] = {}

#: Words that end at white space: anything but space, tab, LF, VT, FF and CR.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ASCII letters, ASCII digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64.  Those of a block are kept, those of a longer text aren't."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        steps = np.full(max(n, BLOCK_BYTES + 2), base, np.uint64)
        steps[0] = 1
        kept = np.cumprod(steps, dtype=np.uint64)
        if n <= BLOCK_BYTES + 2:
            _powers[base] = kept
    return kept[:n]


class SpanHash:
    """Hashes of any spans of one array of symbols, from one prefix sum."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n + 1)[:n], dtype=np.uint64, out=self.prefix[1:])
        self.inverse = powers(_BASE_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _GOLDEN)


def blocks(texts: Sequence[str | None], limit: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``limit`` characters in all, or of one longer text."""
    limit, start, size = limit or BLOCK_BYTES // 2, 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


class Words:
    """Words of a block of texts.  Null counts as empty.

    data: the texts' bytes, each followed by one space; start, end: the words' bytes;
    doc: the index of each word's text; first: index of each text's first word, with the total at the end.
    """

    def __init__(self, texts: Sequence[str | None], word_bytes: np.ndarray, lower: bool):
        raw = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
        data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        self.data = LOWER[data] if lower else data
        self.begins = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in raw], out=self.begins[1:])
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = word_bytes[self.data]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.begins)
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return SpanHash(self.data)(self.start, self.end)

    def text(self, i: int, j: int) -> str:
        """Words i to j - 1, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j])).decode("utf-8", "surrogatepass")


def ngram_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words of the block, runs across texts included; see ``within``."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = out * _GOLDEN + word_hash[i : m + i]
    return mix(out)


def within(words: Words, n: int) -> np.ndarray:
    """Which of the runs of n words lie in one text."""
    m = len(words) - n + 1
    return words.doc[:m] == words.doc[n - 1 :] if m > 0 else np.zeros(0, bool)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, an index of each, and each key's place among them."""
    order = np.argsort(keys)
    placed = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = placed[1:] != placed[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    return placed[fresh], order[fresh], inverse
