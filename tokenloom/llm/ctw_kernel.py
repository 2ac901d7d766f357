"""Context-tree weighting over byte contexts, each byte decomposed into eight binary choices.

A node is a context of the last d bytes; it holds a Krichevsky-Trofimov estimate for each of the 255
binary choices of the next byte. Contexts seen too rarely to be nodes have no node of their own: what
they saw is pooled in their parent's rest leaf, so that every count takes part. The tree is held in two
parts: its top as dense rows (``ContextTree``), the subtrees below in cells that saw something (``Subtrees``).
"""

from __future__ import annotations

import math

import numpy as np

END = 255  # never a byte of UTF-8, so free to end a text


def padded(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with ``depth`` zero bytes before and END after each; places of predicted bytes; row bounds."""
    lengths = np.diff(offsets)
    n = len(lengths)
    shift = np.repeat(np.arange(n) * (depth + 1) + depth, lengths)
    out = np.zeros(len(data) + n * (depth + 1), np.uint8)
    out[np.arange(len(data)) + shift] = data
    ends = offsets[1:] + np.arange(1, n + 1) * (depth + 1) - 1
    out[ends] = END
    asked = np.ones(len(out), bool)
    for d in range(depth):
        asked[offsets[:-1] + np.arange(n) * (depth + 1) + d] = False
    return out, np.flatnonzero(asked), np.append(0, np.cumsum(lengths + 1))


def gram_keys(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Context bytes, nearest last, then the byte itself, as one integer."""
    key = text[places].astype(np.int64)
    for d in range(1, depth + 1):
        key |= text[places - d].astype(np.int64) << (8 * d)
    return key


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma of positive values: the recurrence up to 8, then Stirling's series."""
    y, low = x.astype(np.float64), np.zeros(x.shape)
    for _ in range(8):
        small = y < 8
        if not small.any():
            break
        low[small] -= np.log(y[small])
        y = y + small
    inverse = 1 / y
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    return low + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series


def _choices(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones seen at each of the 255 binary choices (heap order), for rows of 256 counts."""
    zeros, ones = [], []
    for level in range(8):
        halves = counts.reshape(len(counts), 1 << level, 2, 1 << (7 - level)).sum(axis=3)
        zeros.append(halves[:, :, 0])
        ones.append(halves[:, :, 1])
    return np.concatenate(zeros, axis=1), np.concatenate(ones, axis=1)


def _log_pe(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the estimate gave the counts seen."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - math.log(math.pi)


def _next_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


def _byte_logs(ones: np.ndarray) -> np.ndarray:
    """log10 probability of each of the 256 bytes from the chances of a one, rows of 255."""
    out = np.zeros((len(ones), 256))
    for level in range(8):
        p = ones[:, (1 << level) - 1:(2 << level) - 1]
        both = np.log10(np.stack([1 - p, p], axis=2)).reshape(len(ones), 2 << level)
        out += np.repeat(both, 1 << (7 - level), axis=1)
    return out


def _byte_choices(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight binary choices (heap order, from 1) that make each key's byte, and how they were decided."""
    byte, level = (keys & 255)[:, None], np.arange(8)
    return (1 << level) | (byte >> (8 - level)), byte >> (7 - level) & 1


class ContextTree:
    """The weighted tree, frozen, or its part down to ``depth``.

    ``nodes`` maps (depth, context) to 256 counts; every parent of a node is a node. If the tree goes on
    below, ``deeper`` maps contexts of ``depth`` bytes to the zeros, ones and weighted log probabilities
    (255 each) of their child nodes together; without it, nodes of ``depth`` bytes are leaves.
    ``through`` + ``left`` * p is the chance of a one if the part below a node says p.
    """

    def __init__(self, nodes: dict[tuple[int, int], np.ndarray], depth: int, deeper: dict[int, np.ndarray] | None = None):
        nodes = nodes or {(0, 0): np.zeros(256)}
        keys = sorted(nodes)
        at = {k: i for i, k in enumerate(keys)}
        level = np.array([d for d, _ in keys])
        parent = np.array([at[d - 1, c & ((1 << 8 * (d - 1)) - 1)] if d else -1 for d, c in keys])
        zeros, ones = _choices(np.array([nodes[k] for k in keys], np.float64))
        rest_zeros, rest_ones = zeros.copy(), ones.copy()
        np.subtract.at(rest_zeros, parent[1:], zeros[1:])
        np.subtract.at(rest_ones, parent[1:], ones[1:])
        below = np.zeros(zeros.shape)
        for c, (z, o, w) in (deeper or {}).items():
            i = at[depth, c]
            rest_zeros[i] -= z
            rest_ones[i] -= o
            below[i] += w
        inner = (level < depth) | (deeper is not None)
        below += np.where(inner[:, None], _log_pe(rest_zeros, rest_ones), 0.0)  # rest leaf and weighted children
        log_pe, one = _log_pe(zeros, ones), _next_one(zeros, ones)
        own = np.ones(zeros.shape)  # share of the node's own estimate in its mixture
        for d in range(depth, -1, -1):
            rows = np.flatnonzero(level == d)
            weighted = log_pe[rows]
            if len(rows) and inner[rows[0]]:
                both = np.logaddexp(weighted, below[rows])
                own[rows] = np.exp(weighted - both)
                weighted = both + math.log(0.5)
            if d:
                np.add.at(below, parent[rows], weighted)
        self.depth = depth
        self.through, self.left = np.zeros(own.shape), np.ones(own.shape)
        for d in range(depth + 1):
            rows = np.flatnonzero(level == d)
            if d:
                self.through[rows], self.left[rows] = self.through[parent[rows]], self.left[parent[rows]]
            self.through[rows] += self.left[rows] * own[rows] * one[rows]
            self.left[rows] *= 1 - own[rows]
        self.chance = self.through + self.left * _next_one(rest_zeros, rest_ones)
        self.contexts = [np.array([c for x, c in keys if x == d], np.int64) for d in range(depth + 1)]

    @property
    def logs(self) -> np.ndarray:
        """log10 probability of every byte after each node, where no longer context is a node."""
        return _byte_logs(self.chance)

    def rows(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of the longest node that ends each context, and its depth."""
        row, deep, first = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64), 0
        for d, have in enumerate(self.contexts):
            if d and len(have):
                want = contexts & ((1 << 8 * d) - 1)
                at = np.minimum(np.searchsorted(have, want), len(have) - 1)
                hit = have[at] == want
                row[hit], deep[hit] = first + at[hit], d
            first += len(have)
        return row, deep


class Subtrees:
    """Whole subtrees below contexts of ``top`` bytes, from all their grams (``keys``, all different, and counts).

    A level holds the cells (context, binary choice) that its grams pass; all others saw nothing and weigh 1.
    Contexts seen ``least`` times or more are nodes.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, top: int, depth: int, least: float):
        self.keys, self.top, self.depth = keys, top, depth
        self.choice, self.bit = _byte_choices(keys)
        self.cells: dict[int, tuple[np.ndarray, ...]] = {}
        self.places, self.up = {}, {}
        ids, inverse = np.unique((keys >> 8 << 8)[:, None] | self.choice, return_inverse=True)
        inverse = inverse.ravel()
        ones = np.bincount(inverse, (self.bit * counts[:, None]).ravel(), len(ids))
        zeros = np.bincount(inverse, ((1 - self.bit) * counts[:, None]).ravel(), len(ids))
        self.places[depth] = inverse.reshape(-1, 8)
        below = rest_one = None
        for d in range(depth, top, -1):
            head = (ids & 255) == 1
            node = (zeros + ones)[head][np.cumsum(head) - 1] >= least
            log_pe, one = _log_pe(zeros, ones), _next_one(zeros, ones)
            own, weighted = np.ones(len(ids)), log_pe
            if below is not None:
                both = np.logaddexp(log_pe, below)
                own, weighted = np.exp(log_pe - both), both + math.log(0.5)
            self.cells[d] = ids, zeros, ones, node, own, one, one if rest_one is None else rest_one, weighted
            if d == top + 1:
                break
            parents, up = np.unique((ids >> 8 & ((1 << 8 * (d - 1)) - 1)) << 8 | ids & 255, return_inverse=True)
            total = lambda x, up=up, n=len(parents): np.bincount(up, x, n)
            all_zeros, all_ones = total(zeros), total(ones)
            rest_zeros, rest_ones = all_zeros - total(zeros * node), all_ones - total(ones * node)
            below = _log_pe(rest_zeros, rest_ones) + total(weighted * node)
            rest_one = _next_one(rest_zeros, rest_ones)
            self.up[d], self.places[d - 1] = up, up[self.places[d]]
            ids, zeros, ones = parents, all_zeros, all_ones

    def sums(self) -> tuple[np.ndarray, ...]:
        """Per context of ``top`` bytes and choice: zeros, ones and weighted log probabilities of its child nodes."""
        ids, zeros, ones, node, *_, weighted = self.cells[self.top + 1]
        at, up = np.unique(((ids >> 8 & ((1 << 8 * self.top) - 1)) << 8 | ids & 255)[node], return_inverse=True)
        return at, *[np.bincount(up, x[node], len(at)) for x in (zeros, ones, weighted)]

    def logs(self, tree: ContextTree) -> np.ndarray:
        """log10 probability of each gram's byte after its context, ``tree`` being what lies above."""
        row, _ = tree.rows(self.keys >> 8)
        chance = tree.chance[row[:, None], self.choice - 1]
        for d in range(self.top + 1, self.depth + 1):
            ids, _, _, node, own, one, rest_one, _ = self.cells[d]
            if d == self.top + 1:
                above, _ = tree.rows(ids >> 8)
                choice = (ids & 255) - 1
                through, left = tree.through[above, choice], tree.left[above, choice]
            else:
                through, left = through[self.up[d]], left[self.up[d]]
            through = through + left * own * one
            left = left * (1 - own)
            at = self.places[d]
            chance = np.where(node[at], (through + left * rest_one)[at], chance)
        return np.log10(np.where(self.bit == 1, chance, 1 - chance)).sum(axis=1)


class KeyTable:
    """Values by 64-bit key, in buckets by a multiplicative hash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(int(len(keys)).bit_length(), 1)
        mixed = self._bucket(keys)
        order = np.argsort(mixed, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.first = np.searchsorted(mixed[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is held, and its value (0 if not)."""
        bucket = self._bucket(keys)
        at, end = self.first[bucket], self.first[bucket + 1]
        hit, out = np.zeros(len(keys), bool), np.zeros(len(keys))
        live = np.flatnonzero(at < end)
        while len(live):
            same = self.keys[at[live]] == keys[live]
            hit[live[same]] = True
            out[live[same]] = self.values[at[live[same]]]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        return hit, out
