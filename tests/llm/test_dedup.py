"""Suffix dedup, n-gram join and embedding passes against brute force."""

from __future__ import annotations

from collections import Counter

import numpy as np
import plain
import pytest

from tokenloom.llm import suffix_dedup
from tokenloom.llm.components import components
from tokenloom.llm.ngram_join import ngram_join
from tokenloom.llm.suffix_dedup import remove_repeats
from tokenloom.llm.vector_passes import near_vectors


def pairs(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["awkward_docs", "documents"])
def test_ngram_join(request, name):
    docs = request.getfixturevalue(name)
    assert rows(ngram_join(docs)) == Counter(plain.ngram_rows(pairs(docs)))


@pytest.mark.parametrize("name", ["awkward_docs", "documents"])
def test_remove_repeats(request, name):
    docs = request.getfixturevalue(name)
    assert rows(remove_repeats(docs, with_text=False)) == Counter(plain.repeat_rows(pairs(docs)))


def test_remove_repeats_short_overlaps(spark):
    """Texts that share passages of just under, at and just over the depth, in every surrounding."""
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    passages = [text(n) for n in (380, 400, 401, 415, 450, 640, 700)]
    docs = [(i, text(rng.integers(0, 300)) + passages[i % 7] + text(rng.integers(0, 300)) + passages[(i * 3 + 1) % 7]) for i in range(40)]
    near = list(passages[6] * 3)
    for i in range(40, 60):
        for at in rng.integers(0, len(near), 3):
            near[at] = "Z"
        docs.append((i, "".join(near)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(remove_repeats(df, with_text=False)) == Counter(plain.repeat_rows(docs))


@pytest.mark.parametrize("name", ["awkward_docs", "documents"])
def test_shared_words(request, monkeypatch, name):
    """Passages of 50 words that other rows have, also where groups count as hot."""
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 5)
    docs = request.getfixturevalue(name)
    table = pairs(docs)
    found = remove_repeats(docs, with_text=False, words=50)
    assert rows(found.drop("n_shared_words")) == Counter(plain.repeat_rows(table))
    assert rows(found.select("doc_id", "n_shared_words")) == Counter((i, n) for (i, _), n in zip(table, plain.shared_words(table), strict=True))


def test_hot_groups_stay_where_they_are(awkward_docs):
    zones = suffix_dedup._first_pass(awkward_docs.selectExpr("xxhash64(doc_id, text) as r", "coalesce(text, '') as text"), suffix_dedup.byte_tokens(400))
    groups = zones.groupBy("core").count()
    plan = suffix_dedup._with_group(zones, groups, ["core"], "count", 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2 and "LeftAnti" in plan


def test_kept_bytes_and_spans(awkward_docs):
    for r in remove_repeats(awkward_docs).collect():
        assert plain.sha(bytes(r.kept)) == r.kept_sha256
        assert sum(s.end - s.low for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_empty_tables(spark):
    docs = spark.createDataFrame([], plain.SCHEMA)
    assert ngram_join(docs).count() == 0
    assert remove_repeats(docs).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_vectors(vectors).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(a) + 1) for a in range(0, 60) if a % 20] + [(100, 101), (101, 100), (7, 7)]
    links += [(200, int(x)) for x in rng.integers(201, 260, 80)]
    groups = plain.Groups(300)
    for a, b in links:
        groups.join(a, b)
    least = groups.least(list(range(300)))
    touched = {x for a, b in links if a != b for x in (a, b)}
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: least[x] for x in touched}


def vector_links(table, threshold=0.93):
    unit = [None] * len(table)
    for i, (_, v, label) in enumerate(table):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            x = x / np.abs(x).max()
            unit[i] = x / np.sqrt(x @ x)
    groups, n = plain.Groups(len(table)), [0] * len(table)
    for i in range(len(table)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and table[i][2] == table[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                n[i] += 1
                n[j] += 1
                groups.join(i, j)
    least = groups.least([t[0] for t in table])
    return [(t[0], k, c, t[0] == c) for t, k, c in zip(table, n, least, strict=True)]


def test_near_vectors_awkward(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    cloud = [(100 + i, (centre + rng.standard_normal(16) * s).tolist(), 1) for i, s in enumerate(np.linspace(0.01, 0.6, 120))]
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [], 1), (3, [0.0] * 16, 1), (4, [nan] * 16, 1), (5, [inf, 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 2.0], None),
           (8, [1.0, 2.0], 2), (9, [1.0, 2.0], 2), (9, [1.0, 2.0], 2), (10, [2.0, 4.0], 2), (11, [1.0, 2.0], 3), (12, [1.0, 2.0, 0.0], 2),
           (None, [1.0, 2.0], 2), (None, [5.0, -2.0], 2), (13, [1e-38, 2e-38], 2), (14, [-0.0, 1.0], 4), (15, [0.0, 1.0], 4)]
    table = odd + cloud
    df = spark.createDataFrame([(*t, 1, "x") for t in table], "vec_id long, embedding array<double>, label int, c int, n_links string").repartition(3)
    assert rows(near_vectors(df)) == Counter(vector_links(table))


def test_near_vectors_table(spark, sf):
    """The given table has no link of its own, so every third vector gets near copies just above and below the threshold."""
    rng = np.random.default_rng(12)
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").orderBy("vec_id").collect()]
    for at, (vec_id, v, label) in enumerate(table[::3]):
        v = np.array(v)
        for k, cosine in enumerate((0.9, 0.935, 0.96, 0.999)[: 1 + at % 4]):
            side = rng.standard_normal(len(v))
            side -= side @ v / (v @ v) * v
            near = cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine ** 2) * side / np.linalg.norm(side)
            table.append((1_000_000 + 4 * vec_id + k, near.tolist(), label))
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").repartition(3)
    expected, found = Counter(vector_links(table)), rows(near_vectors(df))
    links = sum(r[1] * k for r, k in expected.items())
    assert links > 200
    assert sum(r[1] * k for r, k in found.items()) >= 0.98 * links
    assert sum((found & expected).values()) >= 0.98 * len(table)


@pytest.mark.parametrize("hot", [3, 10_000])
def test_repeated_rows_are_grouped_once(spark, monkeypatch, hot):
    """Rows that are equal as a whole add no span for each of their copies, and zones meet without a join of their groups."""
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(suffix_dedup, "SPREAD", 2)
    rng = np.random.default_rng(8)
    text = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    one, other = text(900), text(700)
    docs = [(1, one)] * 30 + [(2, one[:600] + other), (3, other + one[200:700]), (4, text(900))] + [(i, one[:450]) for i in range(5, 12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    table = df.selectExpr("xxhash64(doc_id, text) as r", "text")
    spans = suffix_dedup.repeated_spans(table, suffix_dedup.byte_tokens(400))
    # the first pass gives a zone of the repeated row at most SPREAD times
    first = suffix_dedup._grouped(suffix_dedup._first_pass(table, suffix_dedup.byte_tokens(400)), False)
    assert max(r["count"] for r in first.groupBy("r", "low").count().collect()) <= 2
    assert spans.count() > 0
    found = remove_repeats(df, with_text=False, words=50)
    assert rows(found.drop("n_shared_words")) == Counter(plain.repeat_rows(docs))
    assert rows(found.select("doc_id", "n_shared_words")) == Counter((i, n) for (i, _), n in zip(docs, plain.shared_words(docs), strict=True))
