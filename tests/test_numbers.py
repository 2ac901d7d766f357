"""Permutations, prefix sums, stage cuts and counts on the way."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tokenloom.operators.batching import permute_batches, stage_cut, stage_plan
from tokenloom.operators.indexing import permuted, with_running_sum
from tokenloom.sources.sinks import write_counted


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 7, 16, 17, 100, 1009, 65_537])
def test_permutation_is_a_bijection(spark, n):
    rows = spark.range(n).select(permuted(F.col("id"), n, 3).alias("a"), permuted(F.col("id"), n, 4).alias("b")).collect()
    assert sorted(r.a for r in rows) == sorted(r.b for r in rows) == list(range(n))
    if n > 100:
        assert sum(abs(r.a - i) for i, r in enumerate(rows)) > n * n // 6  # far from where they were
        assert [r.a for r in rows] != [r.b for r in rows]


def test_permutation_of_large_numbers(spark):
    n = (1 << 58) + 12345
    x = F.col("id") * (n // 1000)
    found = [r.x for r in spark.range(1000).select(permuted(x, n, 1).alias("x")).collect()]
    assert len(set(found)) == 1000 and min(found) >= 0 and max(found) < n


def test_permuted_batches_move_no_row(spark):
    out = permute_batches(spark.range(1000).withColumnRenamed("id", "n"), 16, "n", 1000, 5)
    assert "Exchange" not in plan_of(out) and "Sort" not in plan_of(out)
    sizes = {r["count"] for r in out.groupBy("batch_id").count().collect()}
    assert sizes == {16, 1000 % 16}


def test_running_sum(spark):
    rows = [(i % 7, i, None if i % 11 == 0 else i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, i long, v int").repartition(5)
    found = {r.i: r.before for r in with_running_sum(df, ["g", "i"], "v", partitions=6).collect()}
    total = 0
    for _, i, v in sorted(rows):
        assert found[i] == total
        total += v or 0
    assert "SinglePartition" not in plan_of(with_running_sum(df, ["g", "i"], "v")).split("BroadcastExchange")[0]
    assert with_running_sum(df.where("false"), ["g", "i"], "v").count() == 0


def test_stage_cut(spark):
    lens = [5, 0, 7, 3, 20, 1, 4]
    df = spark.createDataFrame(list(enumerate(lens)), "i long, len int")
    cut = stage_cut(df, ["i"], [("a", 10), ("none", 0), ("b", 14), ("c", 100)])
    assert sorted((r.i, r.start, r.stage, r.take) for r in cut.collect()) == [
        (0, 0, "a", 5), (2, 0, "a", 5), (2, 5, "b", 2), (3, 0, "b", 3), (4, 0, "b", 9), (4, 9, "c", 11), (5, 0, "c", 1), (6, 0, "c", 4)]
    assert {tuple(r) for r in stage_plan(cut, 4).collect()} == {("a", 2, 10, 3), ("b", 3, 14, 4), ("c", 3, 16, 4)}
    assert stage_cut(df, ["i"], [("a", 3)]).count() == 1
    with pytest.raises(ValueError, match="negative"):
        stage_cut(df, ["i"], [("a", -1)])


def test_counts_on_the_way(spark, tmp_path):
    path = str(tmp_path / "out")
    assert write_counted(spark.range(50), path, {"most": F.max("id")}) == {"rows": 50, "most": 49}
    assert spark.read.parquet(path).count() == 50
    empty = str(tmp_path / "empty")
    with pytest.raises(ValueError, match="no rows"):
        write_counted(spark.range(0), empty)
    assert not os.path.exists(empty)
    assert write_counted(spark.range(0), empty, required=False) == {"rows": 0}
