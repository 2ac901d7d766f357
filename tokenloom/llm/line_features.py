"""Task-side features of lines and the linear-chain field over them (two labels: bad 0, good 1)."""

from __future__ import annotations

import numpy as np

from tokenloom.llm import byte_words as bw

# Byte classes that line features count.
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?"
STOPS = b".,;:"
NAMES = ("bias", "short", "long", "upper", "symbols", "marks", "stops", "digits", "word_length",
         "repeats_last", "repeats_near", "copies_line", "no_words", "foreign")
WIDTH = len(NAMES)


def _table(*chars: int) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(chars)] = 1
    return out


_CLASSES = [_table(*range(65, 91)), _table(*range(65, 91), *range(97, 123)), _table(*SYMBOLS), _table(*MARKS),
            _table(*STOPS), _table(*range(48, 58)), _table(*range(128, 256))]


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of all rows (at least one a row), and the first line of each row."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    first = np.arange(len(offsets)) + np.searchsorted(breaks, offsets)
    # a break that ends a row leaves an empty line there, which sorts before the next row's own start
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = offsets[1:]
    return starts, ends, first


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of features for each line, the lines' weights (bytes, 1 at least), the first line of each text."""
    starts, ends, first = line_spans(data, offsets)
    size = ends - starts
    counts = []
    for c in _CLASSES:
        sums = np.append(np.int32(0), np.cumsum(c[data], dtype=np.int32))
        counts.append((sums[ends] - sums[starts]).astype(np.int64))
    upper, letters, symbols, marks, stops, digits, foreign = counts
    word_start, word_end, _ = bw.word_spans(data, offsets)
    a, b = np.searchsorted(word_start, starts), np.searchsorted(word_start, ends)
    words = b - a
    hashes = bw.word_hashes(data, word_start, word_end)
    last, near = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    for back in range(1, 9):
        same = np.zeros(len(hashes), bool)
        same[back:] = hashes[back:] == hashes[:-back]
        near |= same
        if back == 1:
            last = same
    # a word's neighbours may stand in the line before; lines of a few words are judged with them
    count = lambda flags: (lambda s: s[b] - s[a])(np.append(0, np.cumsum(flags)))
    chars = np.maximum(np.add.reduceat(np.append(~bw.SPACE[data], False).astype(np.int64), starts) if len(data) else size * 0, 1)
    chars = np.where(size > 0, chars, 1)
    n = np.maximum(words, 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    key = bw.mix(bw.span_hash(bw.prefix_hash(data), starts, ends) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    copy = np.zeros(len(key), bool)
    copy[order[1:]] = key[order[1:]] == key[order[:-1]]
    copy &= words > 0
    out = np.stack([
        np.ones(len(size)), words < 5, words > 200, upper / np.maximum(letters, 1), np.minimum(symbols / chars, 1) * 4,
        np.minimum(marks / n, 1), np.minimum(stops / n, 1), digits / chars, np.minimum((ends - starts) / n / 10, 3),
        count(last) / n, count(near) / n, copy, words == 0, foreign / chars,
    ], axis=1)
    return out.astype(np.float64), np.maximum(size, 1).astype(np.float64), first


def with_neighbours(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and after (zeros at a text's ends)."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([features, before, after], axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Chain:
    """Forward-backward over many chains at once. ``first`` bounds the chains in the flat lines.

    A chain's score is the sum of ``emission`` over its good lines plus ``step[u, v]`` over neighbours.
    """

    def __init__(self, first: np.ndarray):
        self.first = first
        self.length = np.diff(first)
        self.order = np.argsort(-self.length, kind="stable")
        self.steps = int(self.length.max()) if len(self.length) else 0
        self.alive = np.searchsorted(-self.length[self.order], -np.arange(self.steps), "left") if self.steps else np.zeros(0, int)

    def marginals(self, emission: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Chance that each line is good, expected counts of steps, and the sum of log partitions."""
        n = len(emission)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        score = np.stack([np.zeros(n), emission], axis=1)
        begin, last = self.first[:-1][self.order], self.first[1:][self.order] - 1
        for t in range(self.steps):
            at = begin[:self.alive[t]] + t
            if t:
                prior = forward[at - 1]
                forward[at] = np.logaddexp(prior[:, :1] + step[0], prior[:, 1:] + step[1])
            forward[at] += score[at]
        for t in range(1, self.steps):
            at = last[:self.alive[t]] - t
            after = backward[at + 1] + score[at + 1]
            backward[at] = np.logaddexp(after[:, :1] + step[:, 0], after[:, 1:] + step[:, 1])
        total = forward + backward
        log_z = np.logaddexp(total[:, 0], total[:, 1])
        good = _logistic(total[:, 1] - total[:, 0])
        inner = np.ones(n, bool)
        inner[self.first[:-1]] = False
        at = np.flatnonzero(inner)
        joint = forward[at - 1][:, :, None] + step[None] + (score[at] + backward[at])[:, None, :] - log_z[at][:, None, None]
        return good, np.exp(joint).sum(axis=0), float(log_z[self.first[:-1]].sum())


def fit(features: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and step scores by gradient ascent on the chains' likelihood; ``labels`` has one value a chain."""
    x, chain = with_neighbours(features, first), Chain(first)
    line = np.repeat(labels, np.diff(first)).astype(np.float64)
    weight, step = np.zeros(x.shape[1]), np.zeros((2, 2))
    pairs = np.diff(first) - 1
    seen = np.diag([pairs[labels == 0].sum(), pairs[labels == 1].sum()]).astype(np.float64)
    scale = 1 / max(len(line), 1)
    moment, square = np.zeros(len(weight) + 4), np.zeros(len(weight) + 4)
    for i in range(1, rounds + 1):
        good, expected, _ = chain.marginals(x @ weight, step)
        gradient = np.append(x.T @ (line - good) * scale - penalty * weight, ((seen - expected) * scale - penalty * step).ravel())
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient ** 2
        move = 0.1 * (moment / (1 - 0.9 ** i)) / (np.sqrt(square / (1 - 0.999 ** i)) + 1e-8)
        weight += move[:-4]
        step += move[-4:].reshape(2, 2)
    return weight, step


def quality(data: np.ndarray, offsets: np.ndarray, weight: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length-weighted chance of good lines for each text, each line's chance, first lines."""
    features, size, first = line_features(data, offsets)
    good, _, _ = Chain(first).marginals(with_neighbours(features, first) @ weight, step)
    return np.add.reduceat(good * size, first[:-1]) / np.add.reduceat(size, first[:-1]), good, first
