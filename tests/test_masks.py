"""Masks and batches against the pairwise definition."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import batching, masks

CASES = [
    ([0, 1, 2, 0, 1, -1], [1] * 6),
    ([3, 4, 0, 1], [1] * 4),
    ([0, 1, 2, 3, 0, 1], [1, 0, 1, 1, 1, 1]),
    ([0, 1, 0, 1], [0, 1, 1, 1]),
    ([-1, -1], [0, 0]),
    ([2, 3, 4], [1, 1, 1]),
    ([0], [1]),
]


def pairwise(positions, attention):
    valid = [p >= 0 and a != 0 for p, a in zip(positions, attention)]
    segments, count = [], -1
    for p, v in zip(positions, valid):
        count += p == 0 and v
        segments.append(count if v else -1)
    n = len(positions)
    mask = [[j <= i and segments[i] == segments[j] and valid[i] and valid[j] for j in range(n)]
            for i in range(n)]
    return segments, mask


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(5)
    cases = list(CASES)
    for _ in range(40):
        n = rng.randint(1, 14)
        cases.append(([rng.choice([-1, 0, 0, 1, 2]) for _ in range(n)],
                      [rng.choice([0, 1, 1, 1]) for _ in range(n)]))
    rows = [(i, p, a) for i, (p, a) in enumerate(cases)]
    return spark.createDataFrame(rows, "id int, position_ids array<int>, attention_mask array<int>")


def test_segment_index_and_dense_mask(samples):
    out = masks.dense_mask(samples).withColumn(
        "seg", masks.segment_index(F.col("position_ids"), F.col("attention_mask")))
    for r in out.collect():
        segments, mask = pairwise(r.position_ids, r.attention_mask)
        assert r.seg == segments and r.mask == mask


def test_segment_rows_rebuild_the_mask(samples):
    segments = masks.mask_segments(samples, ["id"]).collect()
    rows = masks.mask_rows(masks.mask_segments(samples, ["id"]), ["id"]).collect()
    for s in samples.collect():
        _, mask = pairwise(s.position_ids, s.attention_mask)
        n = len(mask)
        rebuilt = [[False] * n for _ in range(n)]
        for g in (g for g in segments if g.id == s.id):
            for at, i in enumerate(g["keys"]):
                for j in g["keys"][: at + 1]:
                    rebuilt[i][j] = True
        assert rebuilt == mask
        assert {r.position: r.visible for r in rows if r.id == s.id} == \
            {i: sum(line) for i, line in enumerate(mask) if any(line)}


def test_without_attention(spark):
    df = spark.createDataFrame([(1, [0, 1, 2, 0, 1, -1])], "id int, position_ids array<int>")
    row = masks.dense_mask(df).first()
    assert sum(map(sum, row.mask)) == 9
    lines = masks.mask_text(df, ["id"], 1).orderBy("row").collect()
    assert [r.bits for r in lines] == ["1 0 0 0 0 0", "1 1 0 0 0 0", "1 1 1 0 0 0", "0 0 0 1 0 0",
                                       "0 0 0 1 1 0", "0 0 0 0 0 0"]


def test_batches_and_collate(spark):
    rows = [(i, "hot" if i % 3 else "cold", [i] * (i % 7 + 1), None if i % 2 else [i] * (i % 5 + 1))
            for i in range(60)]
    df = spark.createDataFrame(rows, "id int, shard string, input_ids array<int>, labels array<int>")
    out = batching.training_batches(df, 8, key=["id"], shard="shard", pad_id=99,
                                    use_block_diag_mask=True).collect()
    assert len(out) == 60
    for shard in ("hot", "cold"):
        mine = [r for r in rows if r[1] == shard]
        for b in range(0, len(mine), 8):
            group = mine[b:b + 8]
            width = max(len(r[2]) for r in group)
            for at, (i, _, ids, labels) in enumerate(group):
                r = next(x for x in out if x.id == i)
                assert (r.batch_id, r.row_in_batch) == (b // 8, at)
                n = len(ids)
                assert r.input_ids == ids + [99] * (width - n)
                given = (ids if labels is None else labels)[:n]
                assert r.labels == given + [-100] * (width - len(given))
                assert r.position_ids == list(range(n)) + [-1] * (width - n)
                assert r.attention_mask == pairwise(r.position_ids, [1] * n + [0] * (width - n))[1]


def test_shuffle_is_repeatable(spark):
    df = spark.range(50).withColumn("len", F.lit(1))
    first = batching.assign_batches(df, 7, ["id"], shuffle_seed=1).collect()
    again = batching.assign_batches(df, 7, ["id"], shuffle_seed=1).collect()
    other = batching.assign_batches(df, 7, ["id"], shuffle_seed=2).collect()
    assert sorted(first) == sorted(again) != sorted(other)
    assert sorted(r.id for r in first) == list(range(50))
    with pytest.raises(ValueError):
        batching.assign_batches(df, 0, ["id"])


def test_step_plan_covers_all_rows(spark):
    df = spark.range(100).withColumn("len", F.lit(10))
    steps = batching.step_plan(df, ["id"], batch_size=2, accumulation=3, processes=2, max_steps=3,
                               token_budget=120).orderBy("step").collect()
    assert [(s.step, s.rows, s.tokens, s.reached, s.meets_budget) for s in steps] == \
        [(i, 12, 120, i < 3, True) for i in range(8)] + [(8, 4, 40, False, False)]


def test_unsharded_shuffled_batches(spark):
    df = spark.createDataFrame([(i, [i] * (i % 4 + 1)) for i in range(30)], "id int, input_ids array<int>")
    out = batching.training_batches(df, 4, key=["id"], pad_id=0, shuffle_seed=3).collect()
    assert sorted(r.id for r in out) == list(range(30))
    assert sorted({r.batch_id for r in out}) == list(range(8))
    for b in range(8):
        assert len({len(r.input_ids) for r in out if r.batch_id == b}) == 1
