"""Cutting token sequences into fixed-size blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.arrays import block_at, block_count, numbers
from tokenloom.operators.encode import Encoder, append_end
from tokenloom.operators.guards import drop_blank, min_unit, require_value
from tokenloom.sources.text import scan_text


def split_blocks(df: DataFrame, block_size: int, min_len: int, column: str = "ids") -> DataFrame:
    """One row per block: ``block_no``, ``len``, ``input_ids``; a last block below ``min_len`` goes.

    ``len`` is kept beside the tokens so that planning on a staged table reads no token.
    """
    count = block_count(F.size(column), block_size, min_unit(min_len))
    return _explode_blocks(df, count, block_size, column)


def split_units(df: DataFrame, seq_len: int, min_len: int, column: str = "ids") -> DataFrame:
    """One row per packing unit: a sequence of at most ``seq_len`` whole, a longer one as blocks.

    Adds ``n_units`` (units of the row) for the window fold.
    """
    n = F.size(column)
    df = df.withColumn("n_units", unit_count(n, seq_len, min_len))
    return _explode_blocks(df, F.col("n_units"), seq_len, column)


def unit_count(length: Column, seq_len: int, min_len: int) -> Column:
    blocks = block_count(length, seq_len, min_unit(min_len))
    return F.when(length <= seq_len, 1).otherwise(blocks)


def block_lengths(df: DataFrame, block_size: int, min_len: int,
                  length: str = "n_tokens") -> DataFrame:
    """``split_blocks`` on lengths alone: rows ``block_no, len`` and no token in sight."""
    n = F.col(length)
    return _explode_lengths(df, n, block_count(n, block_size, min_unit(min_len)), block_size)


def unit_lengths(df: DataFrame, seq_len: int, min_len: int, length: str = "n_tokens") -> DataFrame:
    """``split_units`` on lengths alone: rows ``n_units, block_no, len``."""
    n = F.col(length)
    df = df.withColumn("n_units", unit_count(n, seq_len, min_len))
    return _explode_lengths(df, n, F.col("n_units"), seq_len)


def _explode_lengths(df: DataFrame, n: Column, count: Column, size: int) -> DataFrame:
    return (
        df.withColumn("block_no", F.explode(numbers(count)))
        .withColumn("len", F.least(n - F.col("block_no") * size, F.lit(size)))
    )


def _explode_blocks(df: DataFrame, count: Column, size: int, column: str) -> DataFrame:
    others = [c for c in df.columns if c != column]
    n, block = F.size(column), F.col("block_no")
    return (
        df.select(*others, column, F.explode(numbers(count)).alias("block_no"))
        .select(*others, "block_no", F.least(n - block * size, F.lit(size)).alias("len"),
                block_at(F.col(column), block, size).alias("input_ids"))
    )


def chunk_text(df: DataFrame, encoder: Encoder, *, seq_len: int, eos_id: int, min_len: int = 2,
               text_column: str = "text") -> DataFrame:
    """Blank filter, encode, end id, blocks: the training input, one row per block."""
    encoded = encoder.encode(drop_blank(df, text_column), text_column).drop(text_column)
    return split_blocks(append_end(encoded, eos_id), seq_len, min_len)


def training_chunks(spark: SparkSession, path: str, encoder: Encoder | None, *, seq_len: int,
                    eos_id: int | None, min_len: int = 2, text_column: str = "text",
                    dataset_type: str | None = None) -> DataFrame:
    """From files to training blocks, rows keyed by ``pos`` (file position) and ``block_no``."""
    require_value(path, "a source path is required")
    require_value(encoder, "an encoder is required")
    require_value(eos_id, "eos_id is required")
    rows = scan_text(spark, path, text_column, dataset_type)
    return chunk_text(rows, encoder, seq_len=seq_len, eos_id=eos_id, min_len=min_len,
                      text_column=text_column)
