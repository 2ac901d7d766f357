"""Operators do the whole job at any size: rare contexts, large labels, every kind of secret."""

from __future__ import annotations

import numpy as np
import plain
import pyarrow as pa
import pytest

from tokenloom.llm.context_tree import score_texts
from tokenloom.llm.secret_links import redact_secrets, scan_secrets, shown
from tokenloom.llm.vector_passes import near_vectors


@pytest.mark.parametrize("head_grams", [1 << 21, 20])
def test_contexts_seen_twice_are_nodes(spark, head_grams):
    texts = ["abab abab", "the then there", "é日é日", "", "abracadabra", "banana the band"] * 2 + ["q" * 300] * 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    train = [t.encode() for i, t in enumerate(texts) if plain.crc(i) % 10]
    total = sum(len(t) + 1 for t in train)
    expected = plain.tree_log10(train, [t.encode() for t in texts], 5, 2 / total)
    found = {r.doc_id: r.score for r in score_texts(docs, depth=5, head_grams=head_grams).collect()}
    assert np.allclose([found[i] for i in range(len(texts))], expected, rtol=1e-6)


def test_assigned_and_hex_secrets_link_too(spark):
    texts = ["ABCDEFGH12345678 password=hunter22 https://db.example.com/", "id ABCDEFGH12345678 " + "0a" * 20, "a" * 24 + " https://a.example.org/x",
             "ABCDEFGH12345678 \n\n password=hunter22", "password=hunter22 " + "pad " * 120 + "https://db.example.com/", "password=ab https://db.example.com/"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.s for r in scan_secrets(docs).select("doc_id", shown("spans").alias("s")).collect()}
    assert found == {0: "ident:0:16,assign:17:34,endpoint:35:58", 1: "ident:3:19,hex:20:60", 2: "hex:0:24,endpoint:25:48",
                     3: "assign:20:37", 4: "assign:0:17", 5: ""}
    clean = {r.doc_id: r.text for r in redact_secrets(docs).collect()}
    assert [clean[i] for i in range(3)] == ["[SECRET] [SECRET] [SECRET]", "id [SECRET] [SECRET]", "[SECRET] [SECRET]"]
    assert clean[5] == texts[5]


def test_recall_in_a_large_label(spark):
    """Lone pairs at cosines of 0.93 to 0.96 among 100,000 vectors of one label that share a direction."""
    rng = np.random.default_rng(8)
    n, pairs, width = 100_000, 1000, 64
    v = rng.standard_normal((n, width))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[:, 0] += 1
    v /= np.linalg.norm(v, axis=1)[:, None]
    side = rng.standard_normal((pairs, width))
    side -= (side * v[:pairs]).sum(axis=1)[:, None] * v[:pairs]
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = rng.uniform(0.931, 0.96, (pairs, 1))
    v = np.concatenate([v, cosine * v[:pairs] + np.sqrt(1 - cosine ** 2) * side])
    table = pa.table({"vec_id": np.arange(len(v)), "embedding": pa.FixedSizeListArray.from_arrays(v.ravel(), width).cast(pa.list_(pa.float64())), "label": np.ones(len(v), np.int32)})
    found = {r.vec_id: r.component_id for r in near_vectors(spark.createDataFrame(table)).where("n_links > 0").collect()}
    assert np.mean([found.get(i, -1) == found.get(n + i, -2) for i in range(pairs)]) >= 0.95
