"""The pipeline's stages against plain counterparts, each on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as cp
import plain
import pytest

from tokenloom.llm.line_crf import fit_field, score_quality
from tokenloom.llm.mixture import mix_sources


@pytest.fixture(scope="module")
def sf_dir(sf):
    return sf


def text_rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in cp.STAGES] == ["quality", "near_duplicates", "secrets", "mixture", "tokens"]


@pytest.mark.parametrize("name", ["awkward_docs", "documents"])
def test_quality_stage(spark, request, name, sf_dir):
    docs = request.getfixturevalue(name)
    kept = cp.good_documents(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    field = fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = Counter(r.doc_id for r in score_quality(docs, field).where("predicted = 1").collect())
    assert Counter(r.doc_id for r in kept.collect()) == good


@pytest.mark.parametrize("name", ["awkward_docs", "documents"])
def test_near_duplicate_stage(spark, request, name, sf_dir):
    docs = request.getfixturevalue(name)
    rows = text_rows(docs)
    kept = cp.without_near_copies(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    expected = Counter()
    for i, size, component in plain.ngram_rows(rows):
        if size == 0 or i == component:
            expected[i] += 1
    found = Counter(r.doc_id for r in kept.collect())
    # of rows that repeat a kept id and text, one stays
    repeats = {i for (i, _), n in Counter(rows).items() if n > 1}
    for i in set(expected) | set(found):
        assert found[i] == (1 if i in repeats and expected[i] else expected[i]), i


@pytest.mark.parametrize("name", ["awkward_docs", "documents"])
def test_secret_stage(spark, request, name, sf_dir):
    docs = request.getfixturevalue(name)
    clean = cp.without_secrets(spark, docs, sf_dir)
    assert clean.columns == docs.columns
    expected = Counter()
    for i, text in text_rows(docs):
        spans = [s for v in plain.secret_base(text).values() for s in v] + [s[1:] for s in plain.secret_weak(text)]
        out, at = "", 0
        for a, b in sorted(spans):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        expected[i, out + text[at:] if spans else text] += 1
    assert Counter(text_rows(clean)) == expected


def test_mixture_and_token_stages(spark, documents, sf_dir):
    mixed = cp.mixed_sources(spark, documents, sf_dir)
    assert mixed.columns == documents.columns
    taken = Counter({r.doc_id: r.taken for r in mix_sources(documents).collect() if r.taken})
    got = Counter()
    for i, text in text_rows(mixed):
        got[i] += len(plain.words(text))
    assert got == taken
    found = cp.tokens(spark, mixed, sf_dir)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert Counter((r.doc_id, r.decoded_sha256) for r in found.collect()) == Counter((i, plain.sha((t or "").encode())) for i, t in text_rows(mixed))


def test_whole_run(spark, sf_dir):
    rows = cp.run(spark, sf_dir)
    assert rows.count() > 0
    assert {"doc_id", "n_tokens", "ids"} <= set(rows.columns)
