"""Task-side tiles of the block matrix join: int8 products with error bounds, exact scores, bounded heaps."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa

#: Queries and candidates of one product; what a task holds at once follows from them.
TILE_QUERIES, TILE_ROWS, PAIRS = 512, 4096, 1 << 16
#: Above the rounding of float arithmetic in the bounds, for up to a million components.
SLACK = 1e-9


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` components each as doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(column), width)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; exact."""
    if vectors.size == 0:
        return vectors
    _, power = np.frexp(np.abs(vectors).max(axis=1))
    far = np.where(np.abs(power) > 200, power, 0)
    return np.ldexp(vectors, -far[:, None])


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot products, summed from the first component to the last."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


class Rows:
    """Vectors with their norms and their int8 form: code * step is near the unit vector, off by at most ``miss``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, scaled(vectors)
        self.squares = dots(self.vectors, self.vectors)
        unit = self.vectors / np.sqrt(self.squares)[:, None]
        self.step = np.abs(unit).max(axis=1) / 127 if len(ids) else np.zeros(0)
        self.codes = np.rint(unit / self.step[:, None]).astype(np.int8)
        near = self.codes * self.step[:, None]
        self.miss = np.sqrt(((unit - near) ** 2).sum(axis=1))
        self.near = np.sqrt((near ** 2).sum(axis=1))

    def floats(self, low: int, high: int) -> np.ndarray:
        """Codes in a type in which their products sum exactly."""
        kind = np.float32 if self.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
        return self.codes[low:high].astype(kind)


class Nearest:
    """The ``k`` best (score, id) found so far for each query, best first; ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched, place = np.unique(query, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(touched)), self.k), place])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, -score, row))
        first = np.searchsorted(row[order], np.arange(len(touched)))
        best = order[first[:, None] + np.arange(self.k)]
        self.score[touched], self.id[touched] = score[best], ids[best]


def search(queries: Rows, rows: Rows, k: int, best: Nearest) -> None:
    """Put the nearest of ``rows`` into ``best``, exactly.

    A tile's int8 products bound every cosine from both sides. A pair survives when its upper bound
    reaches the query's k-th exact score so far, or the k-th lower bound in the tile where the query has fewer.
    """
    for top in range(0, len(queries.ids), TILE_QUERIES):
        end = min(top + TILE_QUERIES, len(queries.ids))
        left = queries.floats(top, end)
        for low in range(0, len(rows.ids), TILE_ROWS):
            high = min(low + TILE_ROWS, len(rows.ids))
            near = (left @ rows.floats(low, high).T).astype(np.float64)
            near *= queries.step[top:end, None]
            near *= rows.step[None, low:high]
            off = queries.miss[top:end, None] + queries.near[top:end, None] * rows.miss[None, low:high] + SLACK
            own = queries.ids[top:end, None] == rows.ids[None, low:high]
            floor = best.score[top:end, -1].copy()
            fresh = np.flatnonzero(np.isneginf(floor))
            if len(fresh) and high - low > k:
                least = np.where(own[fresh], -np.inf, near[fresh] - off[fresh])
                floor[fresh] = np.partition(least, high - low - k, axis=1)[:, high - low - k]
            q, r = np.nonzero((near + off >= floor[:, None]) & ~own)
            for at in range(0, len(q), PAIRS):
                a, b = q[at:at + PAIRS] + top, r[at:at + PAIRS] + low
                exact = dots(queries.vectors[a], rows.vectors[b]) / (np.sqrt(queries.squares[a]) * np.sqrt(rows.squares[b]))
                best.add(a, exact, rows.ids[b])


def merged(runs: list[tuple[float, int]], k: int) -> list[tuple[float, int]]:
    """The ``k`` best distinct ids of (score, id) pairs by a heap."""
    heap = [(-score, vec_id) for score, vec_id in runs]
    heapq.heapify(heap)
    out: list[tuple[float, int]] = []
    while heap and len(out) < k:
        score, vec_id = heapq.heappop(heap)
        if not out or out[-1] != (-score, vec_id):
            out.append((-score, vec_id))
    return out
