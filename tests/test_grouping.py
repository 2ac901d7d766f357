"""Greedy grouping against a one-pass loop, across chunk and shard borders."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenloom import kernels
from tokenloom.operators.grouping import close_on_overflow, close_on_reach
from tokenloom.operators.indexing import (
    shard_by_hash,
    shard_by_position,
    with_group_index,
    with_row_index,
)


def brute_force(weights, limit, closes_after):
    out, total, group = [], 0, 0
    for w in weights:
        if not closes_after and total and total + w > limit:
            group, total = group + 1, 0
        out.append(group)
        total += w
        if closes_after and total >= limit:
            group, total = group + 1, 0
    return out, total, group


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=60), st.integers(1, 25), st.booleans(),
       st.integers(1, 12))
def test_chained_runs_equal_one_pass(weights, limit, closes_after, chunk):
    if not closes_after:
        weights = [min(w, limit) for w in weights]
    expected, total, group = brute_force(weights, limit, closes_after)
    state, found = (0, 0), []
    for at in range(0, len(weights), chunk):
        part = np.array(weights[at:at + chunk])
        found += kernels.group_run(part, *state, limit, closes_after).tolist()
        table = kernels.summarize_run(part, limit, closes_after)
        left, closed = kernels.carry_over(table, state[0], limit, closes_after)
        state = (left, state[1] + closed)
    assert found == expected
    assert state == (total, group)


@pytest.mark.parametrize("closes_after", [True, False])
@pytest.mark.parametrize("chunk_rows", [7, 50, 10_000])
def test_hot_shard(spark, closes_after, chunk_rows):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 2 else f"s{i % 14}", rng.randint(1, 5)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, shard string, w int")
    fold = close_on_reach if closes_after else close_on_overflow
    found = {(r.shard, r.id): r.g
             for r in fold(df, "shard", ["id"], "w", 17, "g", chunk_rows=chunk_rows).collect()}
    assert len(found) == len(rows)
    for shard in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == shard]
        expected, _, _ = brute_force([r[2] for r in mine], 17, closes_after)
        assert [found[(shard, r[0])] for r in mine] == expected


def test_null_shard_is_a_shard_of_its_own(spark):
    df = spark.createDataFrame([(1, None, 2), (2, "", 2), (3, None, 2)], "id long, shard string, w int")
    rows = close_on_reach(df, "shard", ["id"], "w", 4, "g").orderBy("id").collect()
    assert [(r.shard, r.g) for r in rows] == [(None, 0), ("", 0), (None, 0)]


def test_row_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("(id * 7919) % 1000 as k", "id")
    rows = with_row_index(df, ["k"], "n", partitions=5).collect()
    assert sorted((r.k, r.n) for r in rows) == [(i, i) for i in range(1000)]


def test_group_index_restarts(spark):
    df = spark.range(0, 300, 1, 4).selectExpr("case when id % 3 = 0 then 'a' else 'b' end as g", "id")
    rows = with_group_index(df, "g", ["id"], "n", partitions=6).collect()
    for g in "ab":
        mine = sorted((r.id, r.n) for r in rows if r.g == g)
        assert [n for _, n in mine] == list(range(len(mine)))


def test_shards(spark):
    df = spark.range(0, 100, 1, 3).selectExpr("id * 3 as id")
    exact = shard_by_position(df, ["id"], 4).collect()
    assert all(r.shard == (r.id // 3) % 4 for r in exact)
    fast = shard_by_hash(df, ["id"], 4)
    assert fast.count() == 100 and {r.shard for r in fast.collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        shard_by_hash(df, ["id"], 0)
