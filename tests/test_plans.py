"""Physical plans: what must not shuffle does not, what must be pruned is."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.text import PRETOKENS
from tokenloom.operators import packing
from tokenloom.operators.chunk import chunk_text, split_units
from tokenloom.operators.encode import DictionaryEncoder, FunctionEncoder, append_end, build_dictionary
from tokenloom.operators.finetune import format_rows
from tokenloom.operators.indexing import shard_by_hash, shard_scan
from tokenloom.sources.text import parse_jsonl, scan_parquet
from tokenloom.staging import new_path, stage, staging_area, staging_root


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def encoder(docs):
    return DictionaryEncoder(build_dictionary(docs))


def test_chunking_is_narrow_and_looks_up_once(docs, encoder):
    plan = plan_of(chunk_text(docs.select("doc_id", "text"), encoder, seq_len=64, eos_id=0))
    assert "Exchange" not in plan and "Sort" not in plan
    assert plan.count("ArrowEvalPython") == 1
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "PushedFilters: [IsNotNull(text)]" in plan


def test_plugged_tokenizer_is_narrow(docs):
    plan = plan_of(FunctionEncoder(lambda: None, pattern=PRETOKENS).encode(docs.select("doc_id", "text")))
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_planning_does_not_read_tokens(docs, encoder):
    encoded = append_end(encoder.encode(docs.select("doc_id", "source", "text")), 0)
    units = stage(split_units(encoded.drop("text"), 64, 2), "units")
    rows = plan_of(packing.first_units(units, ["source", "doc_id"]))
    lengths = plan_of(units.select("doc_id", "block_no", "len"))
    assert "input_ids" not in rows and "input_ids" not in lengths


def test_packing_regroups_tokens_once(docs, encoder, spark):
    encoded = append_end(encoder.encode(docs.select("doc_id", "source", "text")), 0).drop("text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(packing.packed_dataset(encoded, seq_len=64, window_units=32, capacity=128, pad_id=0,
                                              shard="source", key="doc_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tokens = [line for line in plan.splitlines() if "collect_list" in line]
    assert len(tokens) == 2
    at = plan.splitlines().index(tokens[1])
    assert "Exchange hashpartitioning(source" in plan.splitlines()[at + 1]
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rendering_stays_in_the_jvm(spark):
    df = spark.createDataFrame(
        [(1, [("user", "q")], "i")],
        "id int, messages array<struct<role:string,content:string>>, instruction string")
    plan = plan_of(format_rows(df).select("prompt"))
    assert "Python" not in plan and "Exchange" not in plan


def test_sharding_a_scan_moves_no_text(docs, sf, spark):
    plan = plan_of(shard_scan(scan_parquet(spark, f"{sf}/documents.parquet", "text"), 8))
    text_moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in text_moves if "text" in line]
    assert "BroadcastHashJoin" in plan
    assert "Exchange" not in plan_of(shard_by_hash(docs, ["doc_id"], 8))


def test_staging_area_leaves_an_empty_folder(spark, tmp_path):
    with staging_area(spark):
        paths = [new_path(spark, "kept") for _ in range(2)]
        spark.range(3).write.parquet(paths[0])
        assert stage(spark.range(5), "t").count() == 5
        left = [p for p in (staging_root(spark).removeprefix("file:") + "/tokenloom",) if os.path.isdir(p)]
        before = len(os.listdir(left[0]))
    assert len(os.listdir(left[0])) == before - 2
    assert not os.path.exists(paths[0])


def test_jsonl_is_parsed_once(spark):
    lines = spark.createDataFrame([('{"text":"a"}',)], "line string")
    assert plan_of(parse_jsonl(lines, "text")).count("from_json(") <= 2  # the generator's node, and its header


def test_staging_follows_the_session(spark, tmp_path):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    root = staging_root(spark)
    assert root == (configured.rstrip("/") if configured else root)
    staged = stage(spark.range(3).withColumn("x", F.lit("a")), "t")
    assert staged.count() == 3 and all(f"{root}/tokenloom/t-" in f for f in staged.inputFiles())
