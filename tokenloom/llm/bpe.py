"""BPE encoding and decoding: batched numpy merge rounds.

All words of a slice of texts stand in one flat symbol array. A round finds the rank of every pair by
binary search over the sorted pair keys, merges each word's lowest-ranked pairs, and drops words that
have none left. Rows are independent, so the operator never shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import bpe_kernel
from tokenloom.llm import byte_words as bw
from tokenloom.llm.components import text_batches


def read_vocabulary(path: str) -> str:
    """Content of a tokenizer file on the driver; it travels to the tasks as a broadcast."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = True, with_decoded: bool = True) -> DataFrame:
    """``id_col``, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.

    ``vocabulary`` is the content of a byte-level BPE file (a few MB whatever the corpus). Null and
    empty texts have no ids and decode to the empty text. Added tokens in a text become their ids.
    Repeated rows and null ids keep a row each; other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    state: dict[str, bpe_kernel.BytePairs] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = state.get("pairs") or state.setdefault("pairs", bpe_kernel.BytePairs(shared.value))
        for batch in batches:
            for low, data, offsets in bw.slices(batch.column(1)):
                found = pairs.encode(data, offsets)
                decoded = [pairs.decode(ids) for ids in found]
                columns = [
                    batch.column(0).slice(low, len(found)),
                    pa.array([len(ids) for ids in found], pa.int64()),
                    pa.array([hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in found]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                ]
                if with_ids:
                    sizes = np.concatenate([[0], np.cumsum([len(ids) for ids in found])])
                    values = np.concatenate(found) if found else np.zeros(0, np.int64)
                    columns.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, pa.int32())))
                if with_decoded:
                    columns.append(pa.array(decoded, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_decoded]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_decoded
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
