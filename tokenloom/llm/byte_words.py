"""Task-side helpers on flat byte arrays: texts of an Arrow column, words, word hashes, shingles.

A slice of texts is one flat uint8 array with row offsets; words and their hashes are found for all
rows together. Hashes are 64 bits: a polynomial over random byte codes, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES, SLICE_ROWS = 1 << 20, 2000

_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LANES = np.random.default_rng(7).integers(1, 1 << 63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one plain string array; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "")


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 row offsets into them."""
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(buffers[2], np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; a run ends before ``limit`` bytes or holds one row."""
    for base in range(0, len(column), SLICE_ROWS):
        texts = as_strings(column.slice(base, SLICE_ROWS))
        _, offsets = flat(texts)
        low = 0
        while low < len(texts):
            high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
            high = min(max(high, low + 1), len(texts))
            yield base + low, *flat(texts.slice(low, high - low))
            low = high


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """At least the first ``n`` powers of ``base``, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, np.uint64(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= SLICE_BYTES + 1:
            _powers[base] = have
    return have


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` takes the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * powers(_BASE, len(data) + 1)[:len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of the bytes ``start`` to ``end`` (exclusive), elementwise."""
    raw = (sums[end] - sums[start]) * powers(_BASE_INVERSE, len(sums))[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per row the offset of its first word (n + 1 entries)."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = ~inside[:-1]
    after[:-1] = ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(data), starts, ends)


def joined_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` neighbouring values (len - n + 1 entries)."""
    count = max(len(hashes) - n + 1, 0)
    total = np.zeros(count, np.uint64)
    for i in range(n):
        total += hashes[i:i + count] * _LANES[i % 64] + np.uint64(i // 64)
    return mix(total)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole run of values, its length included."""
    if not len(hashes):
        return np.uint64(0)
    weights = mix(np.arange(1, len(hashes) + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.sum(hashes * weights, dtype=np.uint64)
    return mix(np.array([total], np.uint64) + np.uint64(len(hashes)))[0]


def word_shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its ``n``-word shingles, A-Z lower-cased.

    A row with fewer words gives its whole word sequence as one shingle; one without words, none.
    """
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    runs = joined_hashes(hashes, n)
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= n:
            found = np.sort(runs[low:high - n + 1])
            keep = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif high > low:
            yield mix(sequence_hash(hashes[low:high]) + np.arange(1, 2, dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)
