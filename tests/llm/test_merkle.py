"""The Merkle manifest against a plain tree, and the layout's address arithmetic."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import veb_layout as veb
from tokenloom.llm.merkle_manifest import audit, build_manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(row: dict) -> str:
    shown = [None if row[f] is None else str(row[f]) for f in FIELDS]
    return plain.sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in shown).encode())


def levels_of(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([plain.sha("".join(below[i:i + 16]).encode()) for i in range(0, len(below), 16)])
    return levels


def climb(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        low = at // 16 * 16
        out.append(("".join(level[low:at]), "".join(level[at + 1:low + 16])))
        at //= 16
    return out


def expected_rows(rows: list[dict]) -> Counter:
    groups = defaultdict(list)
    for row in rows:
        hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0
        later = row | {"text": row["text"].translate(plain.LOWER) if row["text"] is not None else None}
        groups[row["source"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row), leaf(later) if hit else None, row["doc_id"]))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([r[2] for r in sorted(groups[s], key=lambda r: r[:3])]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources]) if sources else []
    out = Counter()
    for k, s in enumerate(sources):
        for at, (_, _, own, found, doc_id) in enumerate(sorted(groups[s], key=lambda r: r[:3])):
            path = climb(trees[s], at) + climb(top, k)
            folded = found or own
            for a, b in path:
                folded = plain.sha((a + folded + b).encode())
            root = top[-1][0]
            out[doc_id, own, trees[s][-1][0], root, plain.sha("".join(a + b for a, b in path).encode()), folded, folded == root] += 1
    return out


def told(docs, height):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = audit(build_manifest(docs, height=height, changes={"text": lowered}, changed=hit), height=height)
    return Counter(map(tuple, found.collect()))


@pytest.mark.parametrize("name, height", [("awkward_docs", 3), ("awkward_docs", 1), ("documents", 1)])
def test_manifest(request, name, height):
    docs = request.getfixturevalue(name)
    rows = [r.asDict() for r in docs.select(*FIELDS).collect()]
    assert told(docs, height) == expected_rows(rows)


def test_one_hot_source_and_many_small_ones(spark):
    """Three levels of subtrees in one source, and more sources than one subtree of two levels holds."""
    rows = [dict(doc_id=i, source="hot" if i % 2 else f"s{i % 600}", lang=None, n_chars=i, text=f"Text {i} É") for i in range(1400)]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert told(docs, 1) == expected_rows(rows) == told(docs, 2)


def test_manifest_without_changes_and_empty(spark, awkward_docs):
    found = audit(build_manifest(awkward_docs)).collect()
    assert len(found) == awkward_docs.count() and all(r.verified for r in found)
    assert audit(build_manifest(awkward_docs.where("false"))).count() == 0


def test_layout_arithmetic():
    for height in range(4):
        for leaves in {1, 2, 16, 17, 255, 256, 257, 1000, 16 ** height}:
            if leaves > 16 ** height:
                continue
            digests = [hashlib.sha256(bytes([i % 251, i // 251])).digest() for i in range(leaves)]
            layout = veb.lay_out(b"".join(digests), height)
            assert len(layout) == 32 * veb.tree_size(height, np.int64(leaves))
            level, places = [d.hex() for d in digests], set()
            for depth in range(height, -1, -1):
                at = veb.place(height, np.int64(leaves), depth, np.arange(len(level)))
                assert [layout[32 * p:32 * p + 32].hex() for p in at.tolist()] == level
                places |= set(at.tolist())
                level = [plain.sha("".join(level[i:i + 16]).encode()) for i in range(0, len(level), 16)]
            assert len(places) * 32 == len(layout)
