"""The block matrix join against brute force, its error bounds, and its bounded heaps."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tokenloom.llm import block_join, int8_tiles
from tokenloom.llm.block_join import nearest


def brute(table, asks, k=5):
    usable = {(i, tuple(v)) for i, v in table if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    rows = [(i, int8_tiles.scaled(np.array([v], np.float64))) for i, v in sorted(usable)]
    out = Counter()
    for i, a in rows:
        if not asks(i):
            continue
        found = []
        for j, b in rows:
            if i != j and a.shape == b.shape:
                found.append((-float(int8_tiles.dots(a, b)[0] / (np.sqrt(int8_tiles.dots(a, a)[0]) * np.sqrt(int8_tiles.dots(b, b)[0]))), j))
        distinct = sorted(set(found))
        for rank, (score, j) in enumerate(distinct[:k], 1):
            out[i, rank, j, -score] += 1
    return out


def awkward_vectors():
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(24)
    table = [(i, rng.standard_normal(24).tolist()) for i in range(160)]
    table += [(200 + i, (centre + rng.standard_normal(24) * 1e-4).tolist()) for i in range(60)]  # nearer than int8 can tell
    table += [(300 + i, centre.tolist()) for i in range(90)] + [(400 + i, (centre * 2.0 ** (i - 2)).tolist()) for i in range(5)]
    nan, inf = float("nan"), float("inf")
    table += [(500, None), (501, []), (502, [0.0] * 24), (503, [nan] * 24), (504, [inf] + [1.0] * 23), (505, [None] + [1.0] * 23), (None, centre.tolist())]
    table += [(600, [1.0, 2.0]), (601, [2.0, 1.0]), (602, [1e200, 3e200]), (603, [1e-300, 1e-300]), (700, [3.0]), (0, [1.0, 1.0])]
    return table + [table[0], table[0], (10, centre.tolist())]


def as_frame(spark, table):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in table], "vec_id long, embedding array<double>, rank int, score string").repartition(5)


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(block_join, "COMPONENTS", 24 * 13)
    monkeypatch.setattr(block_join, "FEWEST", 7)
    table = awkward_vectors()
    df = as_frame(spark, table)
    assert Counter(map(tuple, nearest(df, F.col("vec_id") % 10 == 0).collect())) == brute(table, lambda i: i % 10 == 0)
    assert Counter(map(tuple, nearest(df, F.col("vec_id") == 600, k=9).collect())) == brute(table, lambda i: i == 600, 9)


def test_nearest_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    table = [tuple(r) for r in df.select("vec_id", "embedding").collect()]
    assert Counter(map(tuple, nearest(df, F.col("vec_id") % 50 == 0).collect())) == brute(table, lambda i: i % 50 == 0)


def test_nearest_empty(spark):
    df = as_frame(spark, awkward_vectors())
    assert nearest(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert nearest(df, F.lit(False)).count() == 0
    assert nearest(df.where("vec_id = 600"), F.lit(True)).count() == 0


def test_bounds_hold():
    """The int8 bounds contain every cosine, also of long, sparse and badly scaled vectors."""
    rng = np.random.default_rng(9)
    for width, make in ((1, rng.standard_normal), (64, rng.standard_normal), (1500, rng.standard_cauchy), (300, lambda s: rng.standard_normal(s) * (rng.random(s) < 0.05) + 1e-9)):
        a, b = (int8_tiles.Rows(np.arange(40), make((40, width))) for _ in range(2))
        near = (a.floats(0, 40) @ b.floats(0, 40).T).astype(np.float64) * a.step[:, None] * b.step[None]
        exact = (a.vectors @ b.vectors.T) / np.sqrt(a.squares[:, None] * b.squares[None])
        off = a.miss[:, None] + a.near[:, None] * b.miss[None] + int8_tiles.SLACK
        assert (np.abs(near - exact) <= off).all()
        assert a.floats(0, 1).dtype == (np.float32 if width < 1000 else np.float64)


def test_copies_are_left_out_before_vectors_move(spark, capsys):
    df = as_frame(spark, awkward_vectors())
    equal = df.groupBy("embedding").count().agg(F.max("count")).first()[0]
    assert equal > 80
    candidates, _ = block_join._numbered(df.selectExpr("vec_id as id", "embedding as vector", "vec_id % 10 = 0 as asks").where("vec_id is not null and size(embedding) > 0").distinct(), 5)
    assert candidates.groupBy("vector").count().agg(F.max("count")).first()[0] == 6
