"""Task-side digits of repeated-window search: zones of neighbouring windows, their cores and contexts.

A text is a sequence of tokens, bytes or words. All windows of ``depth`` tokens whose smallest gram (of the
first ``reach`` ones) is the same anchor form a zone. Anchors depend on a window's content alone, so equal
windows lie in zones around equal anchors. A zone's core is what all its windows share, its context what
they cover together, told by two hashes of 64 bits each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tokenloom.llm import byte_words as bw

#: Codes of a sequence's tokens, in two lanes.
Lanes = tuple[np.ndarray, np.ndarray]
_SECOND = np.random.default_rng(90210).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Shape:
    """Window length, gram length, grams that may be the anchor, and how much finer zones are wide."""

    depth: int
    gram: int
    reach: int
    step: int


def byte_shape(depth: int) -> Shape:
    return Shape(depth, 32, max(depth * 3 // 5, 1), 16)


def word_shape(depth: int) -> Shape:
    return Shape(depth, 3, max(depth * 4 // 5, 1), 8)


class Sums:
    """Running sums of a sequence of token codes in two lanes, from which spans are hashed."""

    def __init__(self, codes: Lanes):
        n = len(codes[0])
        weights = bw.powers(bw._BASE, n + 1)[:n]
        self.first, self.second = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        for lane, out in zip(codes, (self.first, self.second), strict=True):
            np.cumsum(lane * weights, out=out[1:])

    def context(self, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        place = (anchor - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return tuple(bw.mix(bw.span_hash(x, low, high + depth) + place).view(np.int64) for x in (self.first, self.second))


def byte_codes(data: np.ndarray) -> Lanes:
    return bw._CODES[data], _SECOND[data]


def word_codes(hashes: np.ndarray) -> Lanes:
    return hashes | np.uint64(1), bw.mix(hashes) | np.uint64(1)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values."""
    have, least = 1, values
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[:len(values) - width + 1], least[width - have:])
    return least


def first_zones(codes: Lanes, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """row, first window, last window, anchor (positions in the row), core and the two contexts of each zone."""
    depth, reach = shape.depth, shape.reach
    empty = np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    if not (lengths >= depth).any():
        return (empty,) * 7
    sums = Sums(codes)
    n = len(codes[0]) - shape.gram + 1
    grams = bw.mix((sums.first[shape.gram:] - sums.first[:-shape.gram]) * bw.powers(bw._BASE_INVERSE, len(codes[0]) + 1)[:n])
    bits = np.uint64(max(int(n).bit_length(), 1))
    least = _sliding_least(((grams >> bits) << bits) | np.arange(n, dtype=np.uint64), reach)
    # a start is a window's when the window ends within its row; neighbours of one anchor have the same least gram
    long = np.flatnonzero(lengths >= depth)
    begins, ends = offsets[long], offsets[long + 1] - depth
    heads = np.union1d(np.flatnonzero(least[1:] != least[:-1]) + 1, begins)
    at = np.searchsorted(begins, heads, "right") - 1
    inside = (at >= 0) & (heads <= ends[at])
    low, row = heads[inside], long[at[inside]]
    high = np.minimum(np.append(heads[1:], len(least))[inside] - 1, ends[at[inside]])
    anchor = (least[low] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    core = bw.span_hash(sums.first, anchor, anchor + depth - reach + 1)
    base = offsets[row]
    return row, low - base, high - base, anchor - base, core.view(np.int64), *sums.context(low, high, anchor, depth)


def finer_zones(codes: Lanes, base: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, depth: int,
                step: int) -> tuple[np.ndarray, ...]:
    """The zones, of rows that begin at ``base``, cut where the distance to the anchor passes a multiple of ``step``.

    First comes the zone that each is a part of; the rest is as in ``first_zones``.
    """
    sums = Sums(codes)
    near, far = anchor - high, anchor - low
    parts = far // step - near // step + 1
    of = np.repeat(np.arange(len(low)), parts)
    t = near[of] // step + np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    start, a = base[of], anchor[of]
    new_high = a - np.maximum(near[of], t * step)
    new_low = a - np.minimum(far[of], t * step + step - 1)
    inner = bw.span_hash(sums.first, start + a - t * step, start + a - t * step + depth - step + 1)
    core = bw.mix(inner + t.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
    return of, new_low, new_high, a, core, *sums.context(start + new_low, start + new_high, start + a, depth)


def distinct_zones(row: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray) -> list[np.ndarray]:
    """Each zone of a row once."""
    order = np.lexsort((low, row))
    row, low = row[order], low[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (low[1:] != low[:-1])
    return [row[new], low[new], high[order][new], anchor[order][new]]


def equal_zones(r: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, core: np.ndarray, context: np.ndarray,
                check: np.ndarray, told: np.ndarray, across: bool) -> list[np.ndarray]:
    """Of zones that share their core with another: r, low, high, anchor, whether others share the context, whether in
    several rows, whether the zone stands for those (one, or those of two rows if ``across``), whether the core has more contexts.

    Bits of ``told`` say what other tasks' zones decide: 1: the core is shared, 2: by more contexts; 4: the context is
    shared, 8: by several rows, 16: the zone stands. Equal places of equal rows come once. Zones that no pass needs are left out.
    """
    order = np.argsort(core)
    ordered = core[order]
    equal = ordered[1:] == ordered[:-1]
    kept = order[np.append(False, equal) | np.append(equal, False) | (told[order] > 0)]
    kept = kept[np.lexsort((low[kept], r[kept], check[kept], context[kept], core[kept]))]
    if not len(kept):
        return [x[kept] for x in (r, low, high, anchor)] + [np.zeros(0, bool)] * 4
    r, low, core, context, check, told = (x[kept] for x in (r, low, core, context, check, told))

    def starts(*columns: np.ndarray) -> np.ndarray:
        new = np.ones(len(kept), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
        return new

    keys = starts(core, context, check)
    key, group = np.cumsum(keys) - 1, np.cumsum(starts(core)) - 1
    first = np.flatnonzero(keys)
    last = np.append(first[1:], len(kept)) - 1
    whole, shared = told & 1 > 0, told & 4 > 0
    same = (last > first)[key] | shared
    apart = np.where(shared, told & 8 > 0, (r[first] != r[last])[key])
    mixed = np.where(whole, told & 2 > 0, np.bincount(group[first])[group] > 1)
    ends = (r == r[first][key]) | (r == r[last][key]) if across else keys
    stands = mixed & np.where(shared, told & 16 > 0, ends)
    out = starts(core, context, check, r, low) & (mixed | (apart if across else same))
    return [x[out] for x in (r, low, high[kept], anchor[kept], same, apart, stands, mixed)]


def merged(low: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans ``low`` to ``end``."""
    if not len(low):
        return low, end
    order = np.argsort(low, kind="stable")
    low, end = low[order], np.maximum.accumulate(end[order])
    new = np.append(True, low[1:] > end[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(low)) - 1
    return low[new], end[last]
