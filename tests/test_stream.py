"""Streams give the batch result, also when windows span micro-batches."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tokenloom.operators.chunk import chunk_text
from tokenloom.operators.encode import DictionaryEncoder, append_end, build_dictionary
from tokenloom.operators.packing import packed_dataset
from tokenloom.plans.queries import REGISTRY
from tokenloom.sources.text import stream_text
from tokenloom.streaming.chunks import stream_chunks
from tokenloom.streaming.packing import StreamPacker


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    rng = random.Random(2)
    folder = tmp_path_factory.mktemp("stream")
    rows = [(i, "hot" if i % 3 else "cold", " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 3, 8, 21]))))
            for i in range(90)]
    schema = "doc_id long, source string, text string"
    for part in range(3):
        df = spark.createDataFrame(rows[part * 30:(part + 1) * 30], schema)
        target = str(folder / f"part-{part}")
        df.coalesce(1).write.parquet(target)
        for name in os.listdir(target):
            os.utime(os.path.join(target, name), (1_700_000_000 + part, 1_700_000_000 + part))
    return spark.createDataFrame(rows, schema), str(folder)


def test_packing_across_batches(spark, source, tmp_path):
    docs, folder = source
    encoder = DictionaryEncoder(build_dictionary(docs))
    stream = stream_text(spark, folder, "text", "parquet", docs.schema, max_files_per_trigger=1,
                         keep=("doc_id", "source"))
    packer = StreamPacker(spark, encoder, output=str(tmp_path / "out"), state=str(tmp_path / "state"),
                          seq_len=10, window_units=8, capacity=12, eos_id=0, pad_id=0, shard="source",
                          key="doc_id")
    streamed = packer.run(stream, str(tmp_path / "log"))
    assert os.path.isdir(tmp_path / "out" / "batch=2")
    assert sorted(os.listdir(tmp_path / "state" / "rows")) == ["1", "2"]  # older carry-over is gone
    encoded = append_end(encoder.encode(docs), 0)
    batch = packed_dataset(encoded, seq_len=10, window_units=8, capacity=12, pad_id=0, shard="source",
                           key="doc_id")
    columns = ["source", "window_id", "bin", "input_ids", "labels", "position_ids", "attention_mask"]
    as_rows = lambda df: sorted(map(repr, df.select(columns).collect()))
    assert as_rows(streamed) == as_rows(batch)
    # A repeated micro-batch rewrites its own folders only.
    before = sorted(map(repr, spark.read.parquet(str(tmp_path / "out" / "batch=1")).collect()))
    packer.state = str(tmp_path / "again")
    packer.pack_batch(docs.where(F.col("doc_id").between(0, 29)), 0)
    packer.pack_batch(docs.where(F.col("doc_id").between(30, 59)), 1)
    assert sorted(map(repr, spark.read.parquet(str(tmp_path / "out" / "batch=1")).collect())) == before


def test_packing_null_shards_and_repeated_keys(spark, tmp_path):
    """Keys that repeat and null shards lose no token, in a stream as in a batch."""
    rows = [(i % 7 or None, "s" if i % 3 else None, " ".join("abcdefgh"[:1 + i % 8])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    encoder = DictionaryEncoder(build_dictionary(df))
    stream = stream_text(spark, str(tmp_path / "in"), "text", "parquet", df.schema, max_files_per_trigger=1, keep=("doc_id", "source"))
    packer = StreamPacker(spark, encoder, output=str(tmp_path / "out"), state=str(tmp_path / "state"), seq_len=10, window_units=8,
                          capacity=12, eos_id=0, pad_id=0, shard="source", key="doc_id")
    encoded = append_end(encoder.encode(df), 0)
    batch = packed_dataset(encoded, seq_len=10, window_units=8, capacity=12, pad_id=0, shard="source", key="doc_id")
    count = lambda out: Counter(t for r in out.collect() for t, m in zip(r.input_ids, r.attention_mask, strict=True) if m)
    expected = Counter(t for r in encoded.collect() for t in r.ids)
    assert count(packer.run(stream, str(tmp_path / "log"))) == expected
    assert count(batch) == expected


def test_chunks_with_a_small_dictionary_head(spark, source, tmp_path):
    docs, folder = source
    dictionary = build_dictionary(docs)
    outs = []
    for entries in (2, 1_000_000):
        encoder = DictionaryEncoder(dictionary, head_entries=entries)
        rows = stream_text(spark, folder, "text", "parquet", docs.schema, max_files_per_trigger=1, keep=("doc_id",))
        path = str(tmp_path / f"out-{entries}")
        stream_chunks(rows, encoder, path, str(tmp_path / f"log-{entries}"), seq_len=4, eos_id=0).awaitTermination()
        outs.append(sorted((r.doc_id, r.block_no, r.input_ids) for r in spark.read.parquet(path).collect()))
    batch = chunk_text(docs, DictionaryEncoder(dictionary), seq_len=4, eos_id=0)
    assert outs[0] == outs[1] == sorted((r.doc_id, r.block_no, r.input_ids) for r in batch.collect())


def test_stream_reads_the_files_of_the_batch(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text":"one"}\n')
    (tmp_path / "b.txt").write_text('{"text":"two"}\n')
    rows = stream_text(spark, str(tmp_path), "text", "jsonl")
    query = rows.writeStream.format("memory").queryName("suffixes").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.text for r in spark.table("suffixes").collect()] == ["one"]


@pytest.mark.parametrize("name, batch", [("stream_chunk", "chunk_documents"), ("stream_small_head", "chunk_documents"), ("stream_pack", "pack_padded")])
def test_queries_over_a_folder_of_files(spark, sf, tmp_path, name, batch):
    """The table may be a folder of part files, as Spark writes it."""
    spark.read.parquet(f"{sf}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found, expected = (sorted(map(repr, REGISTRY[q](spark, str(tmp_path)).collect())) for q in (name, batch))
    assert found and found == expected
