"""A packing stream that is stopped and started again gives the samples of one run."""

from __future__ import annotations

import os
import random
import time
from collections import Counter

import pytest
from tokenloom.operators.encode import DictionaryEncoder, append_end, build_dictionary
from tokenloom.operators.packing import packed_dataset
from tokenloom.plans import queries
from tokenloom.sources.text import stream_text
from tokenloom.streaming.chunks import read_encoded, stream_encoded
from tokenloom.streaming.resumable import ResumablePacker

SCHEMA = "doc_id long, source string, text string"
COLUMNS = ["source", "window_id", "bin", "input_ids", "labels", "position_ids", "attention_mask", "segments"]
OPTIONS = dict(seq_len=10, window_units=8, capacity=12, pad_id=0, shard="source", key="doc_id")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(i, None if i % 11 == 0 else "hot" if i % 3 else "cold", " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 3, 8, 21, 47]))))
            for i in range(90)]


@pytest.fixture(scope="module")
def encoder(spark, rows):
    return DictionaryEncoder(build_dictionary(spark.createDataFrame(rows, SCHEMA)))


@pytest.fixture(scope="module")
def expected(spark, rows, encoder):
    """Samples of one batch run over the first 30, or all, rows."""
    encoded = append_end(encoder.encode(spark.createDataFrame(rows, SCHEMA)), 0)
    packed = lambda df: packed_dataset(df, min_len=2, **OPTIONS)
    return {30: shown(packed(encoded.where("doc_id < 30"))), 90: shown(packed(encoded))}


def write_part(spark, rows, folder, part):
    target = f"{folder}/part-{part}"
    spark.createDataFrame(rows[part * 30:(part + 1) * 30], SCHEMA).coalesce(1).write.parquet(target)
    for name in os.listdir(target):
        os.utime(os.path.join(target, name), (1_700_000_000 + part, 1_700_000_000 + part))


def packer_of(spark, encoder, path, **more):
    return ResumablePacker(spark, encoder, output=f"{path}/out", checkpoint=f"{path}/log", eos_id=0, **OPTIONS, **more)


def stream_of(spark, folder):
    return stream_text(spark, folder, "text", "parquet", spark.createDataFrame([], SCHEMA).schema, max_files_per_trigger=1, keep=("doc_id", "source"))


def shown(df):
    return sorted(map(repr, df.select(*COLUMNS).collect()))


def test_stop_and_start_again(spark, rows, encoder, expected, tmp_path):
    """Runs of their own, one stopped from outside; looking at the open windows in between changes nothing."""
    folder = str(tmp_path / "in")
    write_part(spark, rows, folder, 0)
    packer = packer_of(spark, encoder, tmp_path)
    packer.start(stream_of(spark, folder)).awaitTermination()
    assert shown(packer.samples()) == expected[30]
    assert packer.samples(closing=False).count() < len(expected[30])
    for part in (1, 2):
        write_part(spark, rows, folder, part)
    again = packer_of(spark, encoder, tmp_path)  # nothing is kept in the object
    query = again.start(stream_of(spark, folder), {"processingTime": "0 seconds"})
    while query.isActive and not query.recentProgress:
        time.sleep(0.1)
    query.stop()
    last = packer_of(spark, encoder, tmp_path)
    for _ in range(2):  # the second run finds no new rows
        last.start(stream_of(spark, folder)).awaitTermination()
        assert shown(last.samples()) == expected[90]


def test_lanes_and_idle_windows(spark, rows, encoder, expected, tmp_path):
    """Shards over three lanes lose no token, and windows of idle lanes close."""
    folder = str(tmp_path / "in")
    write_part(spark, rows, folder, 0)
    packer = packer_of(spark, encoder, tmp_path, lanes=3, idle_ms=1)
    query = packer.start(stream_of(spark, folder), {"processingTime": "100 milliseconds"})
    while query.isActive and not (query.lastProgress and query.lastProgress.batchId >= 2):
        time.sleep(0.1)
    query.stop()
    assert packer.waiting().count() == 0
    found = packer.samples(closing=False)
    assert {r.lane for r in found.select("lane").distinct().collect()} == {0, 1, 2}
    count = lambda ids, mask: Counter(t for t, m in zip(ids, mask, strict=True) if m)
    tokens = sum((count(r.input_ids, r.attention_mask) for r in found.collect()), Counter())
    assert tokens == sum((Counter(r.ids) for r in append_end(encoder.encode(spark.createDataFrame(rows[:30], SCHEMA)), 0).collect()), Counter())


def test_large_dictionary_is_refused(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    write_part(spark, rows, str(tmp_path / "in"), 0)
    packer = packer_of(spark, DictionaryEncoder(build_dictionary(docs), head_entries=2), tmp_path)
    with pytest.raises(ValueError, match="larger"):
        packer.start(stream_of(spark, str(tmp_path / "in")))


def test_large_dictionary_through_stored_ids(spark, rows, expected, tmp_path):
    """A dictionary beyond what tasks are handed: one query encodes, the other packs, both stop and go on."""
    docs = spark.createDataFrame(rows, SCHEMA)
    encoder = DictionaryEncoder(build_dictionary(docs), head_entries=2)
    folder, ids = str(tmp_path / "in"), str(tmp_path / "ids")
    for part in range(3):
        write_part(spark, rows, folder, part)
        stream_encoded(stream_of(spark, folder), encoder, ids, str(tmp_path / "encode-log")).awaitTermination()
        packer = packer_of(spark, encoder, tmp_path)
        packer.start_encoded(read_encoded(spark, ids, docs.drop("text").schema)).awaitTermination()
    assert shown(packer.samples()) == expected[90]


def test_resumed_query_with_a_large_dictionary(spark, sf, tmp_path, monkeypatch):
    spark.read.parquet(f"{sf}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    plain = queries._encoder
    monkeypatch.setattr(queries, "_encoder", lambda *at: plain(*at, head_entries=50))
    found, batch = (sorted(map(repr, queries.REGISTRY[q](spark, str(tmp_path)).collect())) for q in ("stream_pack_resumed", "pack_padded"))
    assert found and found == batch
