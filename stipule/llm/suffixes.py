"""Suffix order, longest previous factors and content-defined runs, in numpy.

All of this concerns strings of ``LENGTH`` bytes: windows.  Each window has an
anchor, the least hashed ``GRAM``-byte string within it, leftmost if repeated.
``GRAM`` is long enough that common phrases seldom make an anchor frequent.
The anchor depends on the window's bytes alone, so equal windows have equal
anchors wherever they occur; neighbouring windows mostly share theirs and form a
run.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from stipule.llm.sketch import MIX, mixed

LENGTH, GRAM = 50, 24
#: Windows looked at together in one text.
STRIDE = 1 << 19


class Runs(NamedTuple):
    """First windows, ends (exclusive) and anchor hashes of the runs of a text."""

    start: np.ndarray
    end: np.ndarray
    anchor: np.ndarray


def words_at(data: np.ndarray) -> np.ndarray:
    """At each place, the eight bytes from there as a big-endian number."""
    v = data.astype(np.uint64)
    for shift in (1, 2, 4):
        v = (v[:-shift] << np.uint64(8 * shift)) | v[shift:]
    return v


def _piece(data: np.ndarray) -> Runs:
    v = words_at(data)
    gram = np.zeros(len(data) - GRAM + 1, np.uint64)
    for o in range(0, GRAM, 8):
        gram = mixed(gram * MIX[0] + v[o : o + len(gram)])
    # Low bits hold the place, so the least value names the leftmost least gram.
    least = (gram & ~np.uint64((1 << 20) - 1)) | np.arange(len(gram), dtype=np.uint64)
    width, span = LENGTH - GRAM + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = (least & np.uint64((1 << 20) - 1)).astype(np.intp)
    cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
    start = np.concatenate([[0], cuts])
    # Least hashes are small numbers: mixing them deals anchors evenly.
    return Runs(start, np.concatenate([cuts, [len(at)]]), mixed(gram[at[start]]))


def runs(data: bytes) -> Runs:
    """The runs of all windows of a text, in order."""
    flat = np.frombuffer(data, np.uint8)
    n = len(flat) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, np.intp)
        return Runs(none, none, np.zeros(0, np.uint64))
    parts = []
    for at in range(0, n, STRIDE):
        piece = _piece(flat[at : min(at + STRIDE, n) + LENGTH - 1])
        parts.append(Runs(piece.start + at, piece.end + at, piece.anchor))
    return parts[0] if len(parts) == 1 else Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def suffix_order(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Windows (columns of words) in suffix order, by owner among equals.

    Only windows that still tie with a neighbour are sorted by the next word.
    """
    order = np.argsort(words[0])
    tied = np.concatenate([[False], words[0][order[1:]] == words[0][order[:-1]]])  # with the one before
    for key in (*words[1:], owner):
        member = tied.copy()
        member[:-1] |= tied[1:]
        at = np.flatnonzero(member)
        if not len(at):
            break
        group = np.cumsum(~tied[at])
        part = order[at]
        part = part[np.lexsort((key[part], group))]
        order[at] = part
        tied[at[1:]] &= key[part[1:]] == key[part[:-1]]
    return order


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each run's bytes, from the sum of their mixed eight-byte words."""
    v = words_at(data)
    many = end - start + LENGTH - 8
    edge = np.cumsum(many) - many
    place = np.arange(int(many.sum())) - np.repeat(edge, many)
    part = mixed(v[place + np.repeat(start, many)] + mixed(place.astype(np.uint64) * MIX[0]))
    return mixed(np.add.reduceat(part, edge) + many.astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)


def window_words(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Each window as rows of big-endian words that cover its ``LENGTH`` bytes."""
    v = words_at(data)
    offsets = [*range(0, LENGTH - 7, 8), *([LENGTH - 8] if LENGTH % 8 else [])]
    return np.stack([v[start + o] for o in offsets])


def common_prefix(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each window in suffix order shares with the one before; 0 for the first."""
    differ = words[:, order[1:]] ^ words[:, order[:-1]]
    out = np.full(differ.shape[1], LENGTH)
    offsets = [*range(0, LENGTH - 7, 8), *([LENGTH - 8] if LENGTH % 8 else [])]
    for o, d in reversed(list(zip(offsets, differ, strict=True))):
        some = np.flatnonzero(d)
        high = (d[some] >> np.uint64(32)).astype(np.float64)
        low = (d[some] & np.uint64(0xFFFFFFFF)).astype(np.float64)
        bits = np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])
        out[some] = o + bits // 8
    return np.concatenate([[0], out])


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place, the nearest place before it with a smaller value, or -1.

    Places follow each other's answers: all between a place and its candidate
    are known not to be smaller, so jumps lose nothing and lengths double.
    """
    at = np.arange(-1, len(values) - 1)
    held = np.append(values, np.iinfo(np.int64).min)  # place -1 is below all
    todo = np.flatnonzero(held[at] >= values)
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[held[at[todo]] >= values[todo]]
    return at


def repeated(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each window also starts in an owner of smaller number.

    The longest factor that starts in a smaller owner is shared with the nearest
    smaller owner before or after in suffix order; a window repeats if that
    factor has its full length.
    """
    if not len(owner):
        return np.zeros(0, bool)
    order = suffix_order(words, owner)
    ranked, shared = owner[order], common_prefix(words, order)
    # Two places have a full common prefix if no shorter one lies between them.
    block = np.cumsum(shared < LENGTH)
    before = previous_smaller(ranked)
    after = len(ranked) - 1 - previous_smaller(ranked[::-1])[::-1]
    longest = np.zeros(len(ranked), int)
    for there in (before, after):
        inside = (there >= 0) & (there < len(ranked))
        at = np.clip(there, 0, len(ranked) - 1)
        longest = np.maximum(longest, np.where(inside & (block[at] == block), LENGTH, 0))
    out = np.zeros(len(owner), bool)
    out[order] = longest >= LENGTH
    return out


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of intervals as disjoint, non-touching intervals in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(pairs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out
