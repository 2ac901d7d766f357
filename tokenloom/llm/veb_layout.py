"""Task-side van Emde Boas layout of one aligned subtree of a 16-way hash tree.

A subtree of height h over n leaves is one byte string. Its levels are split in half: the upper half
comes first, then every lower subtree from left to right, each laid out the same way. Only the last
subtree of a level can be short, so the place of any node follows by arithmetic from n alone, and no
pointer is stored. A node is 32 bytes; hashes are taken over hex text.
"""

from __future__ import annotations

import hashlib

import numpy as np

FAN = 16
DIGEST = 32


def height_of(leaves: int, most: int) -> int:
    """Levels above the leaves until one node is left, at most ``most``."""
    height = 0
    while height < most and FAN ** height < leaves:
        height += 1
    return height


def run_hash(digests: bytes) -> bytes:
    return hashlib.sha256(digests.hex().encode()).digest()


def _halves(height: int) -> tuple[int, int]:
    """Levels of the upper half, height of the lower subtrees."""
    upper = (height + 1) // 2
    return upper, height - upper


def lay_out(leaves: bytes, height: int) -> bytes:
    """The subtree over ``leaves`` (digests one after another), root first."""
    if height == 0:
        return leaves
    upper, lower = _halves(height)
    width = DIGEST * FAN ** lower
    parts = [lay_out(leaves[at:at + width], lower) for at in range(0, len(leaves), width)]
    roots = b"".join(part[:DIGEST] for part in parts)
    run = DIGEST * FAN
    above = b"".join(run_hash(roots[at:at + run]) for at in range(0, len(roots), run))
    return b"".join([lay_out(above, upper - 1), *parts])


def _ceil(a: np.ndarray, b: int) -> np.ndarray:
    return -(-a // b)


def tree_size(height: int, leaves: np.ndarray) -> np.ndarray:
    """Nodes of a subtree."""
    return sum(_ceil(leaves, FAN ** up) for up in range(height + 1))


def place(height: int, leaves: np.ndarray, depth: int, index: np.ndarray) -> np.ndarray:
    """Place in the layout of the nodes ``index`` of one depth (0: the root)."""
    if height == 0:
        return np.zeros_like(index)
    upper, lower = _halves(height)
    full = FAN ** lower
    above = _ceil(_ceil(leaves, full), FAN)
    if depth < upper:
        return place(upper - 1, above, depth, index)
    span = FAN ** (depth - upper)
    tree = index // span
    inside = place(lower, np.minimum(full, leaves - tree * full), depth - upper, index - tree * span)
    return tree_size(upper - 1, above) + tree * tree_size(lower, np.int64(full)) + inside


def runs(layout: bytes, height: int, leaves: int) -> list[list[str]]:
    """Per level from the leaves up, the hex text of every run of siblings; the root has none."""
    nodes = np.frombuffer(layout, np.uint8).reshape(-1, DIGEST)
    out = []
    for depth in range(height, 0, -1):
        count = -(-leaves // FAN ** (height - depth))
        at = place(height, np.int64(leaves), depth, np.arange(count, dtype=np.int64))
        text = nodes[at].tobytes().hex()
        width = 2 * DIGEST * FAN
        out.append([text[k:k + width] for k in range(0, len(text), width)])
    return out


def siblings(levels: list[list[str]], leaf: int) -> tuple[list[str], list[str]]:
    """What stands left and right of the path from ``leaf`` to the subtree's root, level by level."""
    left, right = [], []
    for level in levels:
        run, at = level[leaf // FAN], leaf % FAN * 2 * DIGEST
        left.append(run[:at])
        right.append(run[at + 2 * DIGEST:])
        leaf //= FAN
    return left, right


def fold(digest: str, left: list[str], right: list[str]) -> str:
    """The root that ``digest`` leads to between the given siblings."""
    for a, b in zip(left, right, strict=True):
        digest = hashlib.sha256(f"{a}{digest}{b}".encode()).hexdigest()
    return digest
