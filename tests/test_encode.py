"""Dictionary encoding: both routes, special tokens, pre-tokenization."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest
import regex
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tokenloom import kernels
from tokenloom.functions.text import PRETOKENS, WHITESPACE, is_nonblank, pieces, strip
from tokenloom.operators.chunk import chunk_text, training_chunks
from tokenloom.operators.encode import (
    DictionaryEncoder,
    FunctionEncoder,
    append_end,
    build_dictionary,
    truncate,
)
from tokenloom.operators.guards import drop_blank
from tokenloom.sources.special import special_ids

TEXTS = ["the cat and the dog", "the  end\n", "a rare rarest word", "", "the", "dog dog dog cat zebra"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def encode_all(encoder, docs):
    return {r.doc_id: r.ids for r in encoder.encode(docs).collect()}


def test_dictionary_order(docs):
    rows = build_dictionary(docs).orderBy("id").collect()
    assert [(r.token, r.n, r.id) for r in rows[:3]] == [("dog", 4, 1), ("the", 4, 2), ("cat", 2, 3)]
    assert [r.id for r in rows] == list(range(1, len(rows) + 1))


def test_routes_agree(docs):
    dictionary = build_dictionary(docs)
    ids = {r.token: r.id for r in dictionary.collect()}
    expected = {i: [ids[w] for w in t.split()] for i, t in enumerate(TEXTS)}
    assert encode_all(DictionaryEncoder(dictionary), docs) == expected
    small = DictionaryEncoder(dictionary, head_entries=2)
    assert small.tail is not None
    assert encode_all(small, docs) == expected


def test_long_pieces_and_repeated_keys(spark):
    """Pieces longer than the head takes, and rows whose keys are null or repeat."""
    rule, url = "-" * 200, "x" * 5000
    texts = [f"a {rule} b", f"{rule} {url}", "a b c d e", f"e d {url}", None, "c"]
    ids = [1, 1, None, None, 1, 2]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    dictionary = build_dictionary(df)
    known = {r.token: r.id for r in dictionary.collect()}
    expected = sorted((repr(i), [known[w] for w in (t or "").split()]) for i, t in zip(ids, texts, strict=True))
    for entries in (2, 1_000_000):
        encoder = DictionaryEncoder(dictionary, head_entries=entries)
        assert encoder.tail is not None
        assert sorted((repr(r.doc_id), r.ids) for r in encoder.encode(df).collect()) == expected


def test_training_path(spark, tmp_path):
    """Files to blocks, JSON lines and Parquet, with a small and a whole dictionary head."""
    lines = ["the cat and the dog", " ", "a rare rarest word", "dog dog dog cat zebra"]
    (tmp_path / "rows.jsonl").write_text("".join(json.dumps({"text": t}) + "\n" for t in lines) + "{bad\n")
    (tmp_path / "other.txt").write_text(json.dumps({"text": "not read"}) + "\n")
    df = spark.createDataFrame([(t,) for t in lines], "text string")
    df.write.parquet(str(tmp_path / "rows.parquet"))
    dictionary = build_dictionary(drop_blank(df))
    known = {r.token: r.id for r in dictionary.collect()}
    expected = sorted(b for t in lines if t.strip() for b in [([known[w] for w in t.split()] + [0])[i:i + 3] for i in (0, 3)] if len(b) >= 2)
    for entries in (2, 1_000_000):
        encoder = DictionaryEncoder(dictionary, head_entries=entries)
        for kind, path in (("jsonl", tmp_path), ("parquet", tmp_path / "rows.parquet")):
            out = training_chunks(spark, str(path), encoder, seq_len=3, eos_id=0, dataset_type=kind)
            assert sorted(r.input_ids for r in out.collect()) == expected


def test_unknown_pieces(spark, docs):
    dictionary = build_dictionary(docs).where("token <> 'zebra'")
    for bounds in ({}, {"head_entries": 2}):
        with pytest.raises(PySparkException):
            encode_all(DictionaryEncoder(dictionary, **bounds), docs)
        known = encode_all(DictionaryEncoder(dictionary, unk_id=77, **bounds), docs)
        assert known[5][-1] == 77


def test_function_encoder(docs):
    def load():
        return lambda texts: [[len(t), ord(t[0])] for t in texts]

    found = encode_all(FunctionEncoder(load, pattern=r"[^ \t\r\n]+"), docs)
    assert found == {i: [x for w in t.split() for x in (len(w), ord(w[0]))] for i, t in enumerate(TEXTS)}


def test_end_and_truncate(spark):
    df = spark.createDataFrame([(1, []), (2, [4, 5])], "id int, ids array<int>")
    out = truncate(append_end(df, 9), 2).collect()
    assert [(r.id, r.ids) for r in out] == [(2, [4, 5])]
    with pytest.raises(ValueError):
        append_end(df, None)


def test_chunks_skip_blank(spark, docs):
    blank = docs.unionByName(spark.createDataFrame([(9, " 　"), (10, None)], docs.schema))
    chunks = chunk_text(blank, DictionaryEncoder(build_dictionary(docs)), seq_len=4, eos_id=0)
    rows = chunks.orderBy("doc_id", "block_no").collect()
    assert [(r.doc_id, r.block_no, len(r.input_ids)) for r in rows] == [
        (0, 0, 4), (0, 1, 2), (1, 0, 3), (2, 0, 4), (4, 0, 2), (5, 0, 4), (5, 1, 2)]
    assert all(r.input_ids[-1] == 0 for r in rows if (r.doc_id, r.block_no) in [(0, 1), (1, 0), (4, 0)])


def test_special_tokens_are_whole_pieces(spark):
    special = special_ids()
    df = spark.createDataFrame(
        [(1, "a<|im_start|>b <think>c</think><|im_end|><|im_end|> <|nope|>d<")], "doc_id long, text string")
    dictionary = spark.createDataFrame(
        [("a", 1), ("b", 2), ("c", 3), ("<|nope|>d<", 4)], "token string, id long")
    found = encode_all(DictionaryEncoder(dictionary, special=special), df)[1]
    assert found == [1, 248045, 2, 248068, 3, 248069, 248046, 248046, 4]


MIXED = [
    "It's  he'LL weſ \n\n  next", "tabs\t\tand nbsp　wide ", "नमस्ते 12345 你好，世界!",
    "a,b;;  ..\r\n\r\nend   ", "   ", "é́ x'd 'S", "\U0001f600\U0001f601 ok", "\x0b\x0cv f\x1c\x85g",
]


def test_pretokens_match_the_pattern(spark):
    df = spark.createDataFrame(list(enumerate(MIXED)), "id int, text string")
    rows = df.select("id", "text", pieces(F.col("text"), PRETOKENS).alias("p")).collect()
    for r in rows:
        assert "".join(r.p) == r.text
        # Unicode White_Space leaves out \x1c-\x1f, which the regex package counts in.
        if "\x1c" not in r.text:
            assert r.p == regex.findall(PRETOKENS, r.text, flags=regex.V1), r.text


def test_whitespace_is_pythons(spark):
    assert set(WHITESPACE) == {chr(c) for c in range(0x30000) if chr(c).isspace()}
    rows = [(c, f"{chr(c)}") for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame(rows, "c int, t string")
    out = df.select("c", is_nonblank(F.col("t")).alias("full"), strip(F.col("t")).alias("s")).collect()
    for r in out:
        assert r.full == (not chr(r.c).isspace()), hex(r.c)
        assert r.s == chr(r.c).strip(), hex(r.c)


def test_batches_stay_small_however_much_a_task_reads(spark):
    """A task's Arrow batches are bounded, so a Python worker holds no more texts of a large input than of a small one."""
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(0, 9000, 1, 1).select(F.concat(F.lit("w"), "id").alias("text"))
    encoder = FunctionEncoder(lambda: lambda found: [[len(found)]] * len(found), pattern=r"[^ \t\r\n]+")
    sizes = encoder.encode(rows).select(F.max(F.col("ids")[0]).alias("most"), F.count("*").alias("n")).first()
    assert sizes.n == 9000 and sizes.most <= 4000


def test_lookup_tells_what_it_lacks():
    """Ids and missing pieces leave the worker together, so the pieces themselves don't go back."""
    given = pa.array([["a", "x", "b"], [], None, ["y", "y"], ["b"]], pa.list_(pa.string()))
    found = kernels.lookup_known(given, pa.array(["a", "b"]), pa.array([1, 2], pa.int32()))
    assert found.field("ids").to_pylist() == [[1, None, 2], [], [], [None, None], [2]]
    assert found.field("missing").to_pylist() == [["x"], [], [], ["y", "y"], []]
