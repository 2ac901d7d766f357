"""Readers, writers and guards."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tokenloom.operators import guards
from tokenloom.operators.chat import check_expectations, render
from tokenloom.operators.chunk import training_chunks
from tokenloom.operators.encode import DictionaryEncoder, build_dictionary
from tokenloom.operators.finetune import format_rows
from tokenloom.operators.indexing import reader_shard, shard_scan, with_scan_index
from tokenloom.sources import chat, files, sinks, special, text, vocab

# The first group is kept, the second dropped.
GOOD = [
    ('{"text":"a"}', "a"), (' \t{"x":1,"text":"b c"} ', "b c"), ('{"text":"d","text":"e"}', "e"),
    ('{"text":1,"text":"f"}', "f"), ('{"text":"g","v":NaN}', "g"), ('{"text":"\\u00e9\\n"}', "é\n"),
]
BAD = [
    '{"text":5}', '{"text":null}', '{"text":" \\u3000"}', '{"text":{"text":"a"}}', '{"text":["a"]}', "{bad",
    "[1]", '[{"text":"a"}]', '"text"', "5", "null", '{"text":"a"} x', '{"text":"a"}{"text":"b"}',
    '{"text":"a"},{"text":"b"}', '{"text":"a"}]', '{"text":"a"},', "{'text':'a'}", '{"text":"a",}',
    '{"text":"a"', '{"n":01,"text":"a"}', '{"other":"a"}', "{}", "", "   ", "\u3000",
]


@pytest.fixture()
def jsonl(tmp_path):
    folder = tmp_path / "lines" / "deep"
    folder.mkdir(parents=True)
    (folder / "one.jsonl").write_text("\n".join([line for line, _ in GOOD] + BAD), encoding="utf-8")
    (folder / "two.JSONL").write_text('{"text":"last"}\n', encoding="utf-8")
    (folder / "skip.json").write_text('{"text":"no"}\n', encoding="utf-8")
    return str(tmp_path / "lines")


def test_jsonl_is_strict(spark, jsonl):
    rows = text.scan_text(spark, jsonl, "text", "jsonl").orderBy("pos").collect()
    assert [r.text for r in rows] == [t for _, t in GOOD] + ["last"]


def test_jsonl_odd_column_name(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a.b":"yes"}\n{"a":{"b":"no"}}\n')
    rows = text.scan_jsonl(spark, str(tmp_path), "a.b").collect()
    assert [r["a.b"] for r in rows] == ["yes"]


def test_sharding_counts_lines_before_parsing(spark, jsonl):
    lines = text.scan_lines(spark, jsonl)
    sharded = shard_scan(lines, 3).orderBy("pos").collect()
    assert [r.shard for r in sharded] == [i % 3 for i in range(len(sharded))]
    assert len(sharded) == len(GOOD) + len([b for b in BAD if b.strip()]) + 1
    with pytest.raises(PySparkException, match="removed"):
        with_scan_index(lines.where("line <> '5'")).collect()
    assert reader_shard(rank=1, worker=2, workers=4, world_size=2) == (6, 8)


def test_scan_index_over_many_splits(spark, tmp_path):
    for part in range(3):
        body = "".join(f"{part}-{i}\n\n" for i in range(400))
        (tmp_path / f"p{part}.jsonl").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = with_scan_index(text.scan_lines(spark, str(tmp_path))).orderBy("row_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert len({r.pos.block for r in rows}) > 3
    assert [(r.row_idx, r.line) for r in rows] == [
        (part * 400 + i, f"{part}-{i}") for part in range(3) for i in range(400)]


def test_discovery(spark, jsonl, tmp_path):
    names = lambda df: [os.path.basename(r.path) for r in df.collect()]
    assert names(files.find_jsonl_files(spark, [jsonl])) == ["one.jsonl", "two.JSONL"]
    one = f"{jsonl}/deep/one.jsonl"
    assert names(files.find_files(spark, [jsonl, one, "/nonexistent"], [".jsonl"])) == ["one.jsonl", "two.JSONL"]
    with pytest.raises(FileNotFoundError):
        files.find_parquet_files(spark, [jsonl])
    with pytest.raises(ValueError):
        files.find_dataset_files(spark, [jsonl], "csv")


def test_parquet_scan_prunes_and_orders(spark, tmp_path):
    path = str(tmp_path / "data")
    spark.range(20).select("id", F.col("id").cast("string").alias("text"), F.lit(1).alias("other")) \
        .coalesce(1).write.parquet(path)
    df = text.scan_text(spark, path, "text", "parquet")
    assert df.columns == ["pos", "text"]
    assert [r.text for r in df.orderBy("pos").collect()] == [str(i) for i in range(20)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string," in plan and "other" not in plan
    with pytest.raises(ValueError):
        text.scan_text(spark, path, "text", "csv")
    with pytest.raises(ValueError):
        text.scan_text(spark, "", "text", "parquet")


def test_training_chunks(spark, jsonl):
    rows = text.scan_jsonl(spark, jsonl, "text")
    encoder = DictionaryEncoder(build_dictionary(rows))
    chunks = training_chunks(spark, jsonl, encoder, seq_len=2, eos_id=0, dataset_type="jsonl")
    assert {tuple(r.input_ids)[-1] for r in chunks.collect()} == {0} | {
        r.id for r in build_dictionary(rows).where("token = 'c'").collect()}
    for missing in ({"encoder": None}, {"eos_id": None}, {"path": ""}):
        given = {"path": jsonl, "encoder": encoder, "eos_id": 0, **missing}
        with pytest.raises(ValueError):
            training_chunks(spark, seq_len=2, dataset_type="jsonl", **given)


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "vocab.json").write_text(json.dumps({"a": 0, "Ġb": 1, '"': 2}), encoding="utf-8")
    for path in (str(tmp_path), str(tmp_path / "vocab.json")):
        assert {(r.token, r.id) for r in vocab.read_dictionary(spark, path).collect()} == \
            {("a", 0), ("Ġb", 1), ('"', 2)}
    table = vocab.read_dictionary(spark, str(tmp_path))
    vocab.write_dictionary(table, str(tmp_path / "saved"))
    table.write.parquet(str(tmp_path / "saved.parquet"))
    for name in ("saved", "saved.parquet"):
        assert vocab.read_dictionary(spark, str(tmp_path / name)).count() == 3
    with pytest.raises(FileNotFoundError):
        vocab.read_dictionary(spark, str(tmp_path / "absent"))


def test_special_tokens(spark):
    rows = {r.id: r for r in special.special_tokens(spark).collect()}
    assert len(rows) == 33 and min(rows) == 248044 and max(rows) == 248076
    assert rows[248046].content == "<|im_end|>" and rows[248068].content == "<think>"
    assert rows[248058].special is False and rows[248076].special is True
    assert sum(r.additional for r in rows.values()) == 13
    assert special.resolve_pad_id(None, 4) == 4 and special.resolve_pad_id(0, 4) == 0
    with pytest.raises(ValueError):
        special.resolve_pad_id(None, None)


SAMPLES = [
    {"id": "one", "messages": [{"role": "system", "content": "Be brief."},
                               {"role": "user", "content": "什么是 X？"}],
     "expected": {"must_include": ["X", "是"], "max_chars": 10}},
    {"id": "two", "tools": [{"type": "function", "function": {"name": "w", "z": 1, "a": {"城": "b"}}}],
     "messages": [{"role": "user", "content": "查"}],
     "expected": {"tool_call": {"name": "w", "args": {"ort": "Łódź"}}}},
    {"messages": [{"role": "user", "content": [{"type": "text", "text": "hi "}, {"image": "p"}]},
                  {"role": "assistant", "content": None, "reasoning_content": "r", "tool_calls": [
                      {"type": "function", "function": {"name": "f", "arguments": {"b": 1.0, "a": [1, {"k": "é"}]}}}]}],
     "expected": {"must_include": ["a"], "min_chars": 3}},
    {"id": "bad", "messages": [{"role": "user", "content": 5}]},
]


@pytest.fixture()
def samples(spark, tmp_path):
    path = tmp_path / "samples.json"
    path.write_text(json.dumps(SAMPLES, ensure_ascii=False), encoding="utf-8")
    return chat.read_chat_samples(spark, str(path))


def test_chat_samples(samples):
    out = {r.id: r for r in render(samples, tools="tools").collect()}
    assert out["one"].prompt == ("<|im_start|>system\nBe brief.<|im_end|>\n"
                                 "<|im_start|>user\n什么是 X？<|im_end|>\n")
    line = '{"type": "function", "function": {"name": "w", "z": 1, "a": {"\\u57ce": "b"}}}'
    assert f"<tools>\n{line}\n</tools>" in out["two"].prompt
    assert out[None].prompt == (
        "<|im_start|>user\nhi <|vision_start|><|image_pad|><|vision_end|><|im_end|>\n"
        "<|im_start|>assistant\n<think>\nr\n</think>\n\n<tool_call>\n<function=f>\n"
        "<parameter=b>\n1.0\n</parameter>\n"
        '<parameter=a>\n[1, {"k": "\\u00e9"}]\n</parameter>\n</function>\n</tool_call><|im_end|>\n')
    assert out["bad"].prompt is None and "Unexpected content type." in out["bad"].errors


def test_expectations(spark, samples):
    named = samples.withColumn("id", F.coalesce("id", F.lit("none")))
    answers = spark.createDataFrame(
        [("one", "X 是 y", None, None), ("two", "", "w", '{ "ort":"\\u0141ódź"}'), ("none", "ab", None, None),
         ("bad", "anything", None, None)],
        "id string, answer string, tool_name string, tool_args string")
    out = {r.id: r for r in check_expectations(named, answers).collect()}
    assert [out[k].passed for k in ("one", "two", "none", "bad")] == [True, True, False, True]
    assert out["none"].includes_all and not out["none"].length_ok
    wrong = answers.withColumn("tool_args", F.lit('{"ort":"Kraków"}')).withColumn("answer", F.lit("X"))
    out = {r.id: r for r in check_expectations(named, wrong).collect()}
    assert not out["two"].tool_ok and not out["one"].includes_all


def test_prompt_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, "é\n"), (None, 7, "two")], "given string, n int, prompt string")
    df = df.withColumn("id", sinks.sample_id(F.col("given"), F.col("n")))
    out = str(tmp_path / "files")
    assert sinks.write_prompt_files(df, out) == 2
    assert sinks.write_prompt_files(df, out) == 2
    names = sorted(n for n in os.listdir(out) if n.endswith(".txt"))
    assert names == ["a.prompt.txt", "sample_007.prompt.txt"]
    assert open(f"{out}/a.prompt.txt", encoding="utf-8", newline="").read() == "é\n"
    listed = spark.read.json(f"{out}/manifest")
    assert {r.output for r in listed.collect()} == {f"{out}/{n}" for n in names}
    sinks.write_samples(df, str(tmp_path / "rows"), partition_by=["n"])
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 2


def test_guards(spark):
    empty = spark.createDataFrame([], "text string")
    with pytest.raises(ValueError, match="nothing here"):
        guards.require_rows(empty, "nothing here")
    full = spark.createDataFrame([("x",), (" ",), (None,)], "text string")
    assert guards.require_rows(full, "") is full
    assert guards.drop_blank(full).count() == 1
    assert guards.preview(full, ["text"], 2).count() == 2
    assert guards.min_unit(0) == 2 and guards.min_unit(5) == 5
    checked = full.select(guards.checked(F.col("text"), F.col("text").isNotNull(), "null text").alias("t"))
    with pytest.raises(PySparkException, match="null text"):
        checked.collect()


def test_sample_index(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"messages": []}, {"id": "x"}, {"messages": None}]))
    read = chat.read_chat_samples(spark, str(tmp_path / "a.json"))
    names = read.withColumn("id", sinks.sample_id(F.col("id"), F.col("list_index"))).orderBy("list_index")
    assert [(r.id, r.list_index) for r in names.collect()] == [("sample_000", 0), ("x", 1), ("sample_002", 2)]


SFT = [
    {"messages": [{"role": "user", "content": [{"type": "text", "text": "see "}, {"type": "image", "image": "u"}]},
                  {"role": "assistant", "content": "ok", "reasoning_content": "why", "tool_calls": [{"function": {"name": "f", "arguments": {"k": 1}}}]}]},
    {"prompt": 5, "completion": True}, {"prompt": 1.0, "completion": 12345678.5}, {"instruction": False, "output": 1e20, "input": 0},
    {"instruction": "i", "output": 0.00001, "input": "more"}, {"body": 7}, {"body": None}, {"messages": [], "body": "raw"},
]


def sft_prompts(rows):
    return sorted(repr((r.prompt, r.errors)) for r in format_rows(rows, "body").collect())


def test_sft_reader(spark, tmp_path):
    folder = tmp_path / "v1.5"
    folder.mkdir()
    text = "".join(json.dumps(r) + "\n" for r in SFT)
    (folder / "rows.jsonl").write_text(text)
    (folder / "rows.json").write_text('{"body": "not read"}\n')
    (folder / "notes.txt").write_text('{"body": "not read"}\n')
    rows = chat.read_sft_rows(spark, str(folder), "jsonl", text_column="body")
    found = {i: (r.prompt, list(r.errors)) for i, r in enumerate(format_rows(rows.coalesce(1), "body").collect())}
    turn = lambda user, answer: f"<|im_start|>user\n{user}<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n{answer}<|im_end|>\n"
    image = "<|vision_start|><|image_pad|><|vision_end|>"
    assert found[0][0] == (f"<|im_start|>user\nsee {image}<|im_end|>\n<|im_start|>assistant\n<think>\nwhy\n</think>\n\nok\n\n"
                           "<tool_call>\n<function=f>\n<parameter=k>\n1\n</parameter>\n</function>\n</tool_call><|im_end|>\n")
    assert found[1][0] == turn("5", "True") and found[2][0] == turn("1.0", "12345678.5")
    assert found[3][0] == turn("False", "1e+20") and found[4][0] == turn("i\nmore", "1e-05")
    assert found[5][0] == "7" and found[6][0] is None and found[6][1] and found[7][0] == "raw"
    parquet = str(tmp_path / "rows.parquet")
    spark.createDataFrame([(1, True, 2.5), (None, None, None)], "prompt int, completion boolean, body double").write.parquet(parquet)
    read = chat.read_sft_rows(spark, parquet, "parquet", text_column="body").collect()
    assert {(r.prompt, r.completion, r.body, r.messages) for r in read} == {("1", "True", "2.5", None), (None, None, None, None)}
    kept = str(tmp_path / "messages.parquet")
    rows.write.parquet(kept)
    assert sft_prompts(chat.read_sft_rows(spark, kept, "parquet", text_column="body")) != []
    with pytest.raises(ValueError):
        chat.read_sft_rows(spark, str(tmp_path), "csv")


def test_prompt_files_refuse_bad_ids(spark, tmp_path):
    for ids, message in ((["a", "../b"], "not a file name"), (["a", None], "not a file name"), (["a", "a"], "two samples")):
        df = spark.createDataFrame([(i, "text") for i in ids], "id string, prompt string")
        with pytest.raises(ValueError, match=message):
            sinks.write_prompt_files(df, str(tmp_path / "prompts"))
    assert not (tmp_path / "prompts").exists()


def test_prompt_files_of_a_failed_job(spark, tmp_path):
    out = tmp_path / "prompts"
    df = spark.range(40).selectExpr("cast(id as string) as id", "if(id = 33, null, concat('p', id)) as prompt").repartition(4, "id")
    with pytest.raises(Exception, match="no text for '33.prompt.txt'"):
        sinks.write_prompt_files(df, str(out))
    assert os.listdir(tmp_path) == []
    assert sinks.write_prompt_files(df.where("prompt is not null"), f"file:{out}") == 39
    assert (out / "7.prompt.txt").read_text() == "p7"
    (out / "own.txt").write_text("stays")
    more = spark.createDataFrame([("7", "new"), ("100", "")], "id string, prompt string")
    assert sinks.write_prompt_files(more, str(out)) == 2
    assert (out / "7.prompt.txt").read_text() == "new" and (out / "own.txt").exists() and (out / "100.prompt.txt").read_text() == ""
    assert len([n for n in os.listdir(out) if n.endswith(".prompt.txt")]) == 40
    assert sorted(os.listdir(tmp_path)) == ["prompts"]


def test_prompt_files_without_rows(spark, tmp_path):
    assert sinks.write_prompt_files(spark.createDataFrame([], "id string, prompt string"), str(tmp_path / "none")) == 0


def test_samples_without_an_answer_fail(spark):
    samples = spark.createDataFrame(
        [("a", (["x"], None, None, None)), ("b", (["x"], None, None, None)), (None, (None, 1, None, None)), ("c", None)],
        "id string, expected struct<must_include:array<string>,min_chars:long,max_chars:long,tool_call:struct<name:string,args:string>>")
    answers = spark.createDataFrame([("a", "xyz", None, None), (None, "abc", None, None)], "id string, answer string, tool_name string, tool_args string")
    assert {r.id: r.passed for r in check_expectations(samples, answers).collect()} == {"a": True, "b": False, None: True, "c": True}


def test_shard_folders(spark, tmp_path):
    path = str(tmp_path / "shards")
    sinks.write_shards(spark.range(100).selectExpr("id as n", "concat('t', id) as text").repartition(7), path, 6, "n")
    for k in range(6):
        one = sinks.read_shard(spark, path, k)
        assert [r.n for r in one.collect()] == list(range(k, 100, 6))
        files = {r.f for r in one.select(F.input_file_name().alias("f")).collect()}
        assert len(files) == 1 and f"shard={k}" in files.pop()
        assert "PartitionFilters: [isnotnull(shard" in one._jdf.queryExecution().executedPlan().toString()
