"""Stateless streaming: text to ids and to training blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tokenloom.operators.chunk import chunk_text
from tokenloom.operators.encode import Encoder
from tokenloom.operators.guards import drop_blank
from tokenloom.schemas import IDS


def stream_chunks(rows: DataFrame, encoder: Encoder, path: str, checkpoint: str, *, seq_len: int,
                  eos_id: int, min_len: int = 2, text_column: str = "text") -> StreamingQuery:
    """Append the blocks of everything available to Parquet under ``path``, then stop.

    Every micro-batch runs the batch plan, so a dictionary of any size gives the same blocks as there.
    A batch owns the folder of its number; repeating it after a failure writes that folder anew.
    """
    def write(batch: DataFrame, number: int) -> None:
        chunks = chunk_text(batch, encoder, seq_len=seq_len, eos_id=eos_id, min_len=min_len,
                            text_column=text_column)
        chunks.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_encoded(rows: DataFrame, encoder: Encoder, path: str, checkpoint: str, *, text_column: str = "text") -> StreamingQuery:
    """Append the rows of everything available, ``ids`` in place of the text, to Parquet under ``path``, then stop.

    Like ``stream_chunks`` it takes a dictionary of any size. Read ``path`` by a further stream only after this one has ended well:
    a batch that is repeated after a failure has its folder written anew.
    """
    def write(batch: DataFrame, number: int) -> None:
        encoded = encoder.encode(drop_blank(batch, text_column), text_column).drop(text_column)
        encoded.write.mode("overwrite").parquet(f"{path}/batch-{number}")

    return (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_encoded(spark: SparkSession, path: str, kept: T.StructType) -> DataFrame:
    """Stream of the rows that ``stream_encoded`` wrote: the columns ``kept`` and ``ids``."""
    schema = T.StructType([*kept.fields, T.StructField("ids", IDS)])
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)
