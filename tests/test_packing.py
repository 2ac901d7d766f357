"""Packing: the published example, properties, and a brute-force run over random rows."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom import kernels
from tokenloom.operators import packing
from tokenloom.operators.batching import training_batches
from tokenloom.operators.chunk import split_blocks, split_units, unit_lengths


@pytest.fixture(scope="module")
def example(spark):
    """Units 1..10, end id 0: lengths 2..11, block 16."""
    units = packing.synthetic_units(spark.range(1, 11).withColumnRenamed("id", "n"), "n", 0)
    return units.withColumn("shard", F.lit("all")).withColumn("window_id", F.lit(0).cast("long"))


def test_synthetic_units(example):
    rows = {r.n: r.input_ids for r in example.collect()}
    assert rows[1] == [1, 0] and rows[3] == [3, 3, 3, 0] and len(rows[10]) == 11


def test_sequential_example(example):
    bins = packing.pack_sequential(example, capacity=16, shard="shard", order=["n"])
    totals = bins.groupBy("bin").agg(F.sum("len").alias("n_tokens"))
    assert [r.n_tokens for r in totals.orderBy("bin").collect()] == [14, 13, 8, 9, 10, 11]
    summary = packing.summarize(totals, 16, "sequential").first()
    assert (summary.samples, summary.total_tokens, summary.total_capacity) == (6, 65, 96)
    assert summary.shown == "67.71%"


def test_best_fit_example(example):
    bins = packing.pack_windows(example, capacity=16, min_len=2, shard="shard", order=["n"])
    sizes = packing.sample_lengths(bins, ["bin"])
    assert [r.n_tokens for r in sizes.orderBy("bin").collect()] == [16, 16, 16, 15, 2]
    assert packing.summarize(sizes, 16, "best_fit").first().shown == "81.25%"
    samples = packing.build_samples(
        example, bins, key=["n"], sample=["bin"], order=["slot"]).orderBy("bin").collect()
    assert samples[0].input_ids == [10] * 10 + [0] + [4] * 4 + [0]
    assert samples[0].position_ids == list(range(11)) + list(range(5))
    assert samples[0].labels == samples[0].input_ids
    assert [tuple(s) for s in samples[0].segments] == [(0, 0, 11), (1, 11, 5)]


def test_long_units_are_skipped(example):
    bins = packing.pack_sequential(example, capacity=8, shard="shard", order=["n"])
    assert bins.agg(F.max("len")).first()[0] == 8
    kept = packing.pack_windows(example, capacity=8, min_len=3, shard="shard", order=["n"])
    assert sorted(r.len for r in kept.collect()) == [3, 4, 5, 6, 7, 8]


def test_empty_summary(spark):
    empty = spark.createDataFrame([], "n_tokens long")
    row = packing.summarize(empty, 16, "none").first()
    assert (row.samples, row.total_tokens, row.utilization) == (0, 0, 0.0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=50), st.integers(30, 60))
def test_best_fit_contract(lengths, capacity):
    lengths = sorted(lengths, reverse=True)
    bins, slots = kernels.best_fit(lengths, capacity)
    fills: list[int] = []
    for size, chosen in zip(lengths, bins):
        room = [f for f in fills if f + size <= capacity]
        expected = fills.index(max(room)) if room else len(fills)
        assert chosen == expected
        if chosen == len(fills):
            fills.append(0)
        fills[chosen] += size
    assert all(f <= capacity for f in fills)
    for b in set(bins):
        assert [s for s, c in zip(slots, bins) if c == b] == list(range(bins.count(b)))


def test_blocks_and_units(spark):
    rows = [(n, list(range(n))) for n in (1, 2, 8, 9, 10, 16, 17, 18)]
    df = spark.createDataFrame(rows, "id int, ids array<int>")
    blocks = split_blocks(df, 8, 0).collect()
    for n, _ in rows:
        mine = sorted((r.block_no, r.input_ids) for r in blocks if r.id == n)
        assert len(mine) == n // 8 + (n % 8 >= 2)
        assert [x for _, ids in mine for x in ids] == list(range(n if n % 8 != 1 else n - 1))
    units = {(r.id, r.block_no): len(r.input_ids) for r in split_units(df, 8, 4).collect()}
    # Short rows are whole units whatever the minimum; only long rows lose a short last block.
    assert units == {(1, 0): 1, (2, 0): 2, (8, 0): 8, (9, 0): 8, (10, 0): 8,
                     (16, 0): 8, (16, 1): 8, (17, 0): 8, (17, 1): 8, (18, 0): 8, (18, 1): 8}
    lengths = unit_lengths(df.withColumn("n_tokens", F.size("ids")), 8, 4)
    assert {(r.id, r.block_no): r.len for r in lengths.collect()} == units


def test_padding_and_defaults(spark):
    df = spark.createDataFrame(
        [(1, [5, 6, 7], None, None), (2, [1, 2, 3, 4, 5, 6], [9] * 6, [0, 1, 0, 1, 2, 3])],
        "id int, input_ids array<int>, labels array<int>, position_ids array<int>")
    short, long = packing.pad_samples(df, 5, 0).orderBy("id").collect()
    assert short.input_ids == [5, 6, 7, 0, 0] and short.labels == [5, 6, 7, -100, -100]
    assert short.position_ids == [0, 1, 2, -1, -1] and short.attention_mask == [1, 1, 1, 0, 0]
    assert long.input_ids == [1, 2, 3, 4, 5] and long.labels == [9] * 5
    assert long.position_ids == [0, 1, 0, 1, 2] and long.attention_mask == [1] * 5


def check_shard(docs, samples, seq_len, window_units, capacity, min_len):
    """Windows from cumulative unit counts, bins by the packer's contract, no token lost or made.

    ``docs`` are the shard's sequences in order, ``samples`` its ``(window_id, bin, ids)``.
    """
    sizes = np.array([1 if len(d) <= seq_len else len(d) // seq_len + (len(d) % seq_len >= min_len) for d in docs])
    window = np.zeros(len(docs), int)
    start = 0
    while start < len(docs):  # a window ends with the row that brings its units to the limit
        reach = np.cumsum(sizes[start:]) >= window_units
        end = start + int(reach.argmax()) + 1 if reach.any() else len(docs)
        window[start:end] = window[start - 1] + 1 if start else 0
        start = end
    for w in range(window.max() + 1 if len(docs) else 0):
        units = [d[k * seq_len:(k + 1) * seq_len] for d, n in zip(docs, window == w, strict=True) if n
                 for k in range(-(-len(d) // seq_len))]
        usable = Counter(tuple(u) for u in units if min_len <= len(u) <= capacity)
        bins = [ids for v, _, ids in sorted(samples, key=lambda s: s[:2]) if v == w]
        cut = [split_units_of(ids) for ids in bins]
        assert Counter(u for b in cut for u in b) == usable
        assert all(len(ids) <= capacity for ids in bins)
        # longest first into the fullest bin with room: no unit stands in a later bin, or a less full
        # one, while a fuller one had room when its turn came
        order = sorted(((-len(u), b) for b, us in enumerate(cut) for u in us))
        fill = [0] * len(bins)
        for length in sorted({-n for n, _ in order}, reverse=True):
            for _ in range(sum(-n == length for n, _ in order)):
                room = [f for f in fill if f and f + length <= capacity]
                fill[fill.index(max(room)) if room else fill.index(0)] += length
        assert fill == [len(ids) for ids in bins]
    assert {w for w, *_ in samples} <= set(window.tolist())


def split_units_of(ids):
    """Units of a sample: every sequence of the test repeats one number of its own."""
    return [tuple(g) for _, g in itertools.groupby(ids)]


@pytest.mark.parametrize("chunk_rows", [9, 1_000_000])
def test_packed_dataset(spark, chunk_rows):
    rng = random.Random(11)
    # blocks of a sequence differ in their number, so that units stay apart in a sample
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", [3 * i + 1 + k // 12 for k in range(rng.choice([2, 3, 7, 12, 13, 30]))])
            for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, shard string, ids array<int>")
    out = packing.packed_dataset(df, seq_len=12, window_units=9, capacity=16, min_len=2, pad_id=0,
                                 shard="shard", key="doc_id", chunk_rows=chunk_rows).collect()
    for shard in {r[1] for r in rows}:
        mine = [(r.window_id, r.bin, r.input_ids[:sum(r.attention_mask)]) for r in out if r.shard == shard]
        check_shard([r[2] for r in rows if r[1] == shard], mine, 12, 9, 16, 2)
    for r in out:
        assert len(r.input_ids) == len(r.labels) == len(r.position_ids) == 16
        padded = [m == 0 for m in r.attention_mask]
        assert [p == -1 for p in r.position_ids] == padded == [v == -100 for v in r.labels]


def test_capacity_below_the_sequence_length(spark):
    df = spark.createDataFrame([(i, "a", [1] * 100) for i in range(10)], "doc_id long, shard string, ids array<int>")
    with pytest.raises(ValueError, match="do not fit"):
        packing.packed_dataset(df, seq_len=128, window_units=64, pad_id=0, shard="shard", key="doc_id")
    out = packing.packed_dataset(df, seq_len=128, window_units=64, pad_id=0, shard="shard", key="doc_id", skip_long=True)
    assert out.count() == 0
    units = split_units(df, 128, 2)
    assert tuple(packing.left_out(units, 64).first()) == (10, 1000)


def test_batches_with_null_shards_and_repeated_keys(spark):
    rows = [(i // 3, "s" if i % 2 else None, [i + 1] * (1 + i % 4)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, shard string, input_ids array<int>")
    out = training_batches(df, 4, key=["doc_id"], pad_id=0, shard="shard").collect()
    assert Counter((r.shard, tuple(x for x in r.input_ids if x)) for r in out) == Counter((s, tuple(i)) for _, s, i in rows)
    for r in out:
        assert len(r.input_ids) == r.max_len == max(len([x for x in o.input_ids if x]) for o in out if (o.shard, o.batch_id) == (r.shard, r.batch_id))


def test_padding_falls_back_to_the_end_id(spark):
    df = spark.createDataFrame([(1, "a", [5, 6, 9]), (2, "a", [7, 9])], "doc_id long, shard string, ids array<int>")
    packed = packing.packed_dataset(df, seq_len=8, window_units=1, capacity=8, eos_id=9, shard="shard", key="doc_id")
    assert sorted(r.input_ids for r in packed.collect()) == [[5, 6, 9, 9, 9, 9, 9, 9], [7, 9, 9, 9, 9, 9, 9, 9]]
    rows = df.withColumnRenamed("ids", "input_ids")
    assert sorted(r.input_ids for r in training_batches(rows, 2, key=["doc_id"], eos_id=9).collect()) == [[5, 6, 9], [7, 9, 9]]
    for call in (lambda: packing.packed_dataset(df, seq_len=8, shard="shard", key="doc_id"), lambda: training_batches(rows, 2, key=["doc_id"])):
        with pytest.raises(ValueError):
            call()
