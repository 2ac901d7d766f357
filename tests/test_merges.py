"""Byte-pair merges by joins, tokenizer folders, JSON spelling with an indent."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tokenloom.functions.text import json_items, json_text
from tokenloom.operators import merges as merges_module
from tokenloom.operators.merges import BYTE_LEVEL, MergeEncoder, byte_names
from tokenloom.plans.inputs import TOKENIZER
from tokenloom.sources.vocab import read_merges, read_tokenizer, write_merges

TEXTS = [
    "the cat and the dog", "  two  spaces\n\n\tand\r\nlines ", "it's they'll 12 3456 ½", "naïve Ünïcödé 漢字 🙂🙂", "", None, "the",
    "aaaaaaaaa aaaa", "=" * 63, "=" * 64, "=" * 65, "=-" * 400, "x" * 5000 + " tail", "https://example.com/a/b?c=d&e=f#" * 9,
]


@pytest.fixture(scope="module")
def tokenizer(spark):
    return read_tokenizer(spark, TOKENIZER)


@pytest.fixture(scope="module")
def library():
    loaded = Tokenizer.from_file(TOKENIZER)
    loaded.encode_special_tokens = True
    return loaded


def encoded(encoder, spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: list(r.ids) for r in encoder.encode(df).collect()}


def test_equals_the_library(spark, tokenizer, library):
    letters = "abcdet hes.,0159'\né漢"
    random.seed(7)
    made = ["".join(random.choices(letters, k=random.randrange(1, 120))) for _ in range(60)]
    texts = TEXTS + made
    found = encoded(MergeEncoder(*tokenizer), spark, texts)
    assert found == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_small_head_gives_the_same(spark, tokenizer):
    plain = encoded(MergeEncoder(*tokenizer), spark, TEXTS)
    assert encoded(MergeEncoder(*tokenizer, head_pieces=2), spark, TEXTS) == plain


def test_rounds_are_dealt_out_by_pieces(spark, tokenizer, library, monkeypatch):
    """Tasks of a round hold a bounded number of pieces, however few bytes these are in a shuffle."""
    parts = []

    def staged(df, label, plain=merges_module.stage):
        if label == "merge-rounds":
            parts.append(df.rdd.getNumPartitions())
        return plain(df, label)

    monkeypatch.setattr(merges_module, "stage", staged)
    monkeypatch.setattr(merges_module, "PIECES_PER_TASK", 20, raising=False)
    text = " ".join(f"word{i}" for i in range(0, 400, 3))
    assert encoded(MergeEncoder(*tokenizer), spark, [text]) == {0: library.encode(text, add_special_tokens=False).ids}
    assert parts[0] >= 5


def test_given_documents(spark, sf, tokenizer, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = MergeEncoder(*tokenizer).encode(docs).collect()
    expected = library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    assert rows and all(list(r.ids) == e.ids for r, e in zip(rows, expected, strict=True))


def test_empty_table(spark, tokenizer):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert MergeEncoder(*tokenizer).encode(df).columns == ["doc_id", "text", "ids"]
    assert MergeEncoder(*tokenizer).encode(df).count() == 0


def test_unknown_symbol_fails(spark, tokenizer):
    vocab, merges = tokenizer
    df = spark.createDataFrame([(1, "the z")], "doc_id long, text string")
    with pytest.raises(Exception, match="lacks the symbol"):
        MergeEncoder(vocab.where("token <> 'Ġz' and token <> 'z'"), merges.limit(0)).encode(df).collect()


def test_folder_with_merges(spark, tmp_path):
    (tmp_path / "vocab.json").write_text(json.dumps({"a": 0, "b": 1, "ab": 2, "#": 3, "##": 4, "abab": 5}, indent=1))
    (tmp_path / "merges.txt").write_text("#version: 0.2\na b\n\n# #\nab ab\n")
    vocab, merges = read_tokenizer(spark, str(tmp_path))
    assert [(r.left, r.right) for r in merges.orderBy("rank").collect()] == [("a", "b"), ("#", "#"), ("ab", "ab")]
    assert len({r.rank for r in merges.collect()}) == 3
    encoder = MergeEncoder(vocab, merges, pattern=r"\S+")
    assert encoded(encoder, spark, ["ababab ###", "ba"]) == {0: [5, 2, 4, 3], 1: [1, 0]}
    with pytest.raises(FileNotFoundError):
        read_tokenizer(spark, str(tmp_path / "missing"))


def test_merges_written_and_read(spark, tokenizer, tmp_path):
    _, merges = tokenizer
    write_merges(merges, str(tmp_path / "merges.txt"))
    back = read_merges(spark, str(tmp_path / "merges.txt"))
    assert merges.count() == back.count() == 50_000 and merges.exceptAll(back).isEmpty()


def test_byte_names():
    assert len(set(byte_names())) == 256 and byte_names()[32] == "Ġ" and byte_names()[65] == "A"
    assert BYTE_LEVEL.startswith("'s")


VALUES = ['{"b": [1, {"a": []}], "c": {}, "a": "\\u00e9\\n\\"\\/"}', '{"a": 1, "b": 2, "a": [3, 1.0, 1e5, true, null]}', "[]", '"x"', "{bad", None,
          '[[1, 2], {"k": "漢"}]']


@pytest.mark.parametrize("indent", [None, 0, 2, 4])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_json_text(spark, indent, ascii_only):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string")
    rows = df.select("i", json_text(F.col("v"), ascii_only, indent).alias("t"), json_items(F.col("v"), ascii_only, indent).alias("l")).collect()
    for r in rows:
        try:
            value = json.loads(VALUES[r.i])
        except (TypeError, ValueError):
            assert r.t is None and r.l is None
            continue
        assert r.t == json.dumps(value, ensure_ascii=ascii_only, indent=indent)
        if isinstance(value, list):
            assert r.l == [json.dumps(v, ensure_ascii=ascii_only, indent=indent) for v in value]
