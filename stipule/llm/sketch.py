"""Word shingles and HyperMinHash sketches, in numpy.

A text's words are hashed once each, a shingle's hash combines those of its
words, and a text's set is the sorted array of its distinct shingle hashes
(64 bits).  A sketch deals the hashes into ``REGISTERS`` buckets and keeps of
each bucket's least hash its number of leading zeros and the ``MANTISSA`` bits
after the first one: 16 bits a register.  An empty bucket borrows from buckets
that a fixed hash sequence names, so short texts have full sketches too.
"""

from __future__ import annotations

import numpy as np
import xxhash

REGISTERS, MANTISSA = 264, 10
#: Words whose hashes a task remembers.
MEMO = 400_000
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)  # splitmix64's constants


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Turns texts into sets of shingle hashes."""

    def __init__(self, width: int) -> None:
        self.width, self.memo = width, {}

    def words(self, data: bytes) -> np.ndarray:
        """Hashes of the words of a UTF-8 text; A-Z count as a-z."""
        parts, memo = data.lower().split(), self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(parts):
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, parts), np.uint64, len(parts))

    def shingles(self, data: bytes) -> np.ndarray:
        """Sorted distinct hashes of the shingles; a shorter text is one shingle."""
        h = self.words(data)
        if not len(h):
            return h
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out = mixed(out * MIX[0] + h[k : len(h) - width + 1 + k])
        return np.unique(out)


def _borrow() -> np.ndarray:
    """For each bucket, the order in which it looks for a full one: all others, shuffled."""
    rng = np.random.default_rng(5)
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


BORROW = _borrow()


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty sorted set: ``REGISTERS`` values of 16 bits."""
    # The leading bits pick the bucket, so each bucket's hashes stand together.
    bucket = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.intp)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    least = np.minimum.reduceat(mixed(shingles ^ MIX[1]), starts) >> np.uint64(12)
    # 52 bits fit a float, whose exponent tells the leading zeros.
    zeros = np.where(least > 0, 52 - np.frexp(least.astype(np.float64))[1], 52)
    kept = (least << (zeros + 1).astype(np.uint64) >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    held = bucket[starts]
    out = np.empty(REGISTERS, np.uint16)
    out[held] = zeros.astype(np.uint64) << np.uint64(MANTISSA) | kept
    if len(held) < REGISTERS:
        full = np.zeros(REGISTERS, bool)
        full[held] = True
        empty = np.flatnonzero(~full)
        if len(held) < 24:  # so few that ranking them is cheaper than searching for them
            out[empty] = out[held[PLACE[empty][:, held].argmin(axis=1)]]
        else:
            out[empty] = out[BORROW[empty, full[BORROW[empty]].argmax(axis=1)]]
    return out


PLACE = np.argsort(BORROW, axis=1)


def expected_matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of registers that two disjoint sets of these sizes have equal by chance."""
    la, lb = a / REGISTERS, b / REGISTERS
    both, out = la + lb, np.zeros(len(la))
    for i in range(1, 40):
        out += 2.0 ** (-i - MANTISSA) * (np.exp(-both * 2.0**-i) - np.exp(-both * 2.0 ** (1 - i)))
    return np.minimum(0.5, out * la * lb / both)


def estimated(ra: np.ndarray, rb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of sketches, with the sets' sizes."""
    chance = expected_matches(a, b)
    return ((ra == rb).mean(axis=1) - chance) / (1 - chance)


def slack(a: np.ndarray, b: np.ndarray, similarity: float, sigmas: float = 5.0) -> np.ndarray:
    """How far an estimate may fall below ``similarity`` for a pair that reaches it."""
    independent = np.minimum(REGISTERS, np.minimum(a, b))
    return sigmas * np.sqrt(similarity * (1 - similarity) / np.maximum(independent, 1))
