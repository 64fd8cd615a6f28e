"""Batch-wise hashing of texts with numpy: bytes, words, windows and anchors.

Everything here works on the texts of one Arrow batch laid end to end, so that
a batch costs a fixed number of array operations however many rows it has.

Hashes are sums of a random 64-bit value per symbol times powers of an odd
base, modulo 2**64, finished by a bit mixer. They depend on the symbols alone,
so equal runs of symbols have equal hashes in every batch, task and job.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_DRAWS = np.random.default_rng(20261)
BYTE_CODES = _DRAWS.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# positions within a slice take the low bits of a winnowing key
POSITION_BITS = 20
SLICE = 1 << 15
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below ``n`` at least (kept between calls)."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << max(n - 1, 1).bit_length())
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class Rolling:
    """Hashes of any run of a code array in constant time each."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(codes * powers(BASE, n + 1)[:n], out=self.sums[1:])
        self.inverse = powers(INVERSE, n + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed hashes of codes[start:end]; the length takes part in the hash."""
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(raw + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))

    def windows(self, length: int) -> np.ndarray:
        """Mixed hashes of all runs of ``length`` codes, one per start."""
        n = len(self.sums) - 1
        if n < length:
            return np.zeros(0, dtype=U64)
        raw = (self.sums[length:] - self.sums[: n - length + 1]) * self.inverse[: n - length + 1]
        return mix(raw)


@dataclass
class Words:
    """Words of several texts laid end to end."""

    data: np.ndarray  # all bytes
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    bounds: np.ndarray  # word index at which each text begins, and the total
    codes: np.ndarray  # hash of each word


def join_texts(texts: list[bytes], gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with ``gap`` spaces after each text, and each text's offset (and the end)."""
    filler = b" " * gap
    data = np.frombuffer(filler.join(texts) + filler, dtype=np.uint8)
    sizes = np.fromiter((len(t) + gap for t in texts), dtype=np.int64, count=len(texts))
    return data, np.concatenate([[0], np.cumsum(sizes)])


def split_words(texts: list[bytes], lower: bool) -> Words:
    """Words between the separators space and U+0009 to U+000D, A-Z lower-cased on request."""
    data, offsets = join_texts(texts, gap=1)
    if lower:
        data = _LOWER[data]
    space = _IS_SPACE[data]
    edges = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts = np.flatnonzero(edges == -1)
    ends = np.flatnonzero(edges == 1)
    codes = Rolling(BYTE_CODES[data]).spans(starts, ends)
    return Words(data, starts, ends, np.searchsorted(starts, offsets), codes)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every run of ``width`` values, by doubling."""
    have, done = values, 1
    while done * 2 <= width:
        have = np.minimum(have[:-done], have[done:])
        done *= 2
    rest = width - done
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


@dataclass
class Anchors:
    """Runs of windows that share an anchor.

    Every window of ``window`` codes picks the smallest hash among the grams in
    it (the leftmost of equals), so equal windows pick the same gram at the
    same offset. A run is a stretch of consecutive windows with one pick.
    """

    grams: np.ndarray  # hash of the picked gram
    first: np.ndarray  # first window start of the run
    count: np.ndarray  # windows in the run
    text: np.ndarray  # index of the text


def winnow(codes: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[Anchors, Rolling]:
    """Anchor runs of the texts whose codes begin at ``bounds``."""
    rolling = Rolling(codes)
    hashes = rolling.windows(gram)
    width = window - gram + 1
    none = np.zeros(0, dtype=np.int64)
    if len(codes) < window:
        return Anchors(none.astype(U64), none, none, none), rolling
    # slice by slice, which also keeps the minima in the processor's cache
    low = U64((1 << POSITION_BITS) - 1)
    picks = np.empty(len(hashes) - width + 1, dtype=np.int64)
    for base in range(0, len(picks), SLICE):
        part = hashes[base : base + SLICE + width - 1]
        keys = (part & ~low) | np.arange(len(part), dtype=U64)
        picks[base : base + SLICE] = (sliding_minimum(keys, width) & low).astype(np.int64) + base
    # windows that would cross the end of a text are left out
    sizes = np.diff(bounds)
    keep = sizes >= window
    counts = (sizes - window + 1)[keep]
    texts = np.flatnonzero(keep)
    heads = bounds[:-1][keep]
    if not len(texts):
        return Anchors(none.astype(U64), none, none, none), rolling
    before = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(before[-1]) - np.repeat(before[:-1] - heads, counts)
    owner = np.repeat(texts, counts)
    chosen = picks[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return (
        Anchors(hashes[chosen[at]], starts[at], np.diff(np.concatenate([at, [len(starts)]])), owner[at]),
        rolling,
    )
