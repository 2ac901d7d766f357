"""Every registered query against its SQL counterpart, or its columns where SQL has none."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import compare, connect  # noqa: E402

from tokenloom.llm.oracles import SQL  # noqa: E402
from tokenloom.llm.queries import QUERIES  # noqa: E402

COLUMNS = {
    "op1_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words"],
    "op3_line_crf": ["doc_id", "held_out", "score", "predicted"],
    "op5_vector_passes": ["vec_id", "n_links", "component_id", "kept"],
    "op7_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_secret_links": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op9_context_tree": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, name):
    if name in SQL:
        rows, problems = compare(spark, connect(sf), QUERIES[name], SQL[name], sf)
        assert not problems, problems
        assert rows > 0
    else:
        df = QUERIES[name](spark, sf)
        table = "embeddings" if "vec_id" in df.columns else "documents"
        assert df.columns == COLUMNS[name]
        assert df.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_entry_registers_them():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())
