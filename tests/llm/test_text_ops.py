"""BPE, rule ledger, quality classifier and language model against the library, brute force and held-out rows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import bpe_kernel, ctw_kernel, line_features
from tokenloom.llm import byte_words as bw
from tokenloom.llm.bpe import encode_texts, read_vocabulary
from tokenloom.llm.context_tree import score_texts
from tokenloom.llm.line_crf import fit_field, score_quality
from tokenloom.llm.queries import vocabulary_path
from tokenloom.llm.rule_ledger import BASE, CURRENT, POLICIES, ablations, ledger, mask, passes


@pytest.fixture(scope="module")
def vocabulary():
    return read_vocabulary(vocabulary_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("name", ["awkward_docs", "documents"])
def test_bpe(request, vocabulary, library, name):
    docs = request.getfixturevalue(name)
    expected = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        expected[r.doc_id, len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    found = encode_texts(docs, vocabulary).collect()
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in found) == expected
    for r in found:
        assert r.ids_sha256 == plain.sha(np.array(r.ids, "<u4").tobytes())
        assert r.decoded_sha256 == plain.sha(r.decoded.encode())


def test_bpe_random_texts(vocabulary, library):
    rng = np.random.default_rng(2)
    alphabet = list("aabst'rvml  \n\té日!?12") + ["'s", "'re", "<|endoftext|>", "\r\n", "🙂", "\u00a0", "\x1c"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 50))) for _ in range(3000)] + ["a" * 3000, "ab" * 2000, " " * 2000]
    pairs, found = bpe_kernel.BytePairs(vocabulary), []
    for _, data, offsets in bw.slices(pa.array(texts, pa.large_string()), 1 << 12):
        found += [x.tolist() for x in pairs.encode(data, offsets)]
    assert found == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for ids in rng.integers(0, 50257, (200, 12)):
        assert pairs.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("name", ["awkward_docs", "documents"])
def test_rule_measures(request, name):
    docs = request.getfixturevalue(name)
    expected = Counter((r.doc_id, *plain.rule_measures(r.text)) for r in docs.select("doc_id", "text").collect())
    found = ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter(tuple(r) for r in found.collect()) == expected


def test_policies_and_ablations(documents):
    book = ledger(documents).cache()
    bits = [r.failures for r in book.collect()]
    for policy in POLICIES:
        assert book.where(passes(policy)).count() == sum(not b & mask(policy) for b in bits)
    assert book.where(passes(CURRENT) & ~passes(BASE)).count() == 0
    for r in ablations(book).collect():
        one, all_ = mask((r.rule,)), mask(CURRENT)
        assert r.failed == sum(bool(b & one) for b in bits)
        assert r.only == sum(b & all_ == one for b in bits)
        assert r.kept_without == sum(not b & all_ & ~one for b in bits)


def test_rules_keep_good_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    good = ledger(docs).join(labels.where("quality = 1"), "doc_id")
    assert good.where(passes(BASE) & ~passes(CURRENT)).count() <= 0.002 * good.count()


def test_field_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = score_quality(docs, fit_field(docs, labels)).join(labels, "doc_id")
    held = [(r.quality, r.predicted, r.score) for r in scored.collect() if plain.crc(r.doc_id) % 5 == 0]
    good = [p for q, p, _ in held if q == 1]
    bad = [p for q, p, _ in held if q == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1
    assert all(0 <= s <= 1 for *_, s in held)


def test_field_awkward_rows(spark, awkward_docs):
    labels = spark.createDataFrame([(1, 0, 0), (7, 1, 0), (7, 1, 1), (8, None, 0), (None, 1, 0), (16, 0, 0), (12, 1, 0)], "doc_id long, quality int, toxic int")
    field = fit_field(awkward_docs, labels)
    found = score_quality(awkward_docs, field, with_lines=True).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in plain.awkward())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    none = fit_field(awkward_docs, labels.where("false"))
    assert {r.score for r in score_quality(awkward_docs, none).collect()} == {0.5}
    assert score_quality(awkward_docs.where("false"), field).count() == 0


def test_chain_against_enumeration():
    rng = np.random.default_rng(4)
    first = np.array([0, 1, 5, 8])
    emission, step = rng.standard_normal(8), rng.standard_normal((2, 2))
    good, expected, log_z = line_features.Chain(first).marginals(emission, step)
    total, pairs = 0.0, np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        paths = [[(p >> i) & 1 for i in range(b - a)] for p in range(1 << (b - a))]
        weight = np.array([np.exp(sum(emission[a + i] for i, y in enumerate(p) if y) + sum(step[x, y] for x, y in zip(p, p[1:], strict=False))) for p in paths])
        total += np.log(weight.sum())
        weight /= weight.sum()
        assert np.allclose(good[a:b], weight @ np.array(paths))
        for p, w in zip(paths, weight, strict=True):
            for x, y in zip(p, p[1:], strict=False):
                pairs[x, y] += w
    assert np.allclose(expected, pairs) and np.isclose(log_z, total)


def test_lines_of_awkward_rows():
    texts = [t or "" for _, t, *_ in plain.awkward()]
    data, offsets = bw.flat(pa.array(texts, pa.large_string()))
    starts, ends, first = line_features.line_spans(data, offsets)
    found = [[bytes(data[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert found == [t.split("\n") for t in texts]


@pytest.mark.parametrize("depth, resolution", [(0, 1.0), (1, 0.01), (2, 0.02), (3, 0.05)])
def test_tree_against_definition(spark, depth, resolution):
    texts = ["abab abab", "the then there", "é日é日", "", "abracadabra", "banana the band"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    train = [t.encode() for i, t in enumerate(texts) if plain.crc(i) % 10]
    expected = plain.tree_log10(train, [t.encode() for t in texts], depth, resolution)
    found = {r.doc_id: r.score for r in score_texts(docs, depth=depth, resolution=resolution).collect()}
    assert np.allclose([found[i] for i in range(len(texts))], expected, rtol=1e-5)


def test_byte_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    counts = {(0, 0): rng.integers(0, 50, 256) * 4.0}
    counts[1, 65] = np.floor(counts[0, 0] / 3)
    tree = ctw_kernel.ContextTree(counts, 1)
    assert np.allclose((10.0 ** tree.logs.astype(np.float64)).sum(axis=1), 1, atol=1e-5)


@pytest.mark.parametrize("name", ["awkward_docs", "documents"])
@pytest.mark.parametrize("share", [2.0 ** -22, 0.01])
def test_base_scores(request, name, share):
    docs = request.getfixturevalue(name)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = score_texts(docs, head_share=share).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)).collect()
    assert Counter(map(tuple, found)) == Counter((*r[:5], round(r[5], 6)) for r in plain.base_scores(rows))


def test_model_beats_even_bytes_and_handles_nothing(spark, documents):
    scored = score_texts(documents).where("held_out").agg(F.avg("bits_per_byte")).first()[0]
    assert scored < 4.5
    none = spark.createDataFrame([], plain.SCHEMA)
    assert score_texts(none).count() == 0
    only = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    r = score_texts(only).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)
    assert np.isclose(r.score, 4 * 8 * np.log10(0.5))
