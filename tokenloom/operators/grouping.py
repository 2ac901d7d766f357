"""Greedy grouping of ordered rows: a running total that restarts when a group closes.

The result depends on every earlier row of the shard, yet no task reads a whole shard. Rows are
numbered and cut into chunks of ``CHUNK_ROWS`` rows, whatever their number. Each chunk is reduced to
its transition (what an open total on entry turns into on exit); ``BLOCK_CHUNKS`` transitions at a time
are composed into one; the blocks are chained in order, then the chunks within each block in
parallel; and each chunk assigns its groups from its now known entry state. A shard may hold any
share of the table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom import kernels
from tokenloom.operators.indexing import apart, with_row_index
from tokenloom.staging import stage

CHUNK_ROWS = 100_000
BLOCK_CHUNKS = 1000

_STATE = (
    "first_shard string, single boolean, sums array<long>, exits array<long>, "
    "closes array<long>, total long, last_shard string, last_exit long, last_closes long"
)
_ENTRY = "entry_shard string, entry_total long, entry_group long"


def close_on_reach(df: DataFrame, shard: str, order: list[str], weight: str, limit: int,
                   group: str = "window_id", chunk_rows: int | None = None) -> DataFrame:
    """Number groups per shard; a group closes after the row that brings it to ``limit``."""
    return _greedy(df, shard, order, weight, limit, True, group, chunk_rows)


def close_on_overflow(df: DataFrame, shard: str, order: list[str], weight: str, limit: int,
                      group: str = "bin", chunk_rows: int | None = None) -> DataFrame:
    """Number groups per shard; a row that would exceed ``limit`` opens the next group.

    Rows heavier than ``limit`` must have been filtered out.
    """
    return _greedy(df, shard, order, weight, limit, False, group, chunk_rows)


def _greedy(df: DataFrame, shard: str, order: list[str], weight: str, limit: int,
            closes_after: bool, group: str, chunk_rows: int | None) -> DataFrame:
    keyed = df.withColumn("_shard", F.coalesce(F.concat(F.lit("="), F.col(shard).cast("string")),
                                               F.lit("")))
    indexed = with_row_index(keyed, ["_shard", *order], "_row")
    chunk_rows = chunk_rows or CHUNK_ROWS
    chunked = (
        indexed.withColumn("_chunk", F.floor(F.col("_row") / chunk_rows).cast("long"))
        .withColumn("_weight", F.col(weight).cast("long"))
    )

    def summarize(rows: pa.Table) -> pa.Table:
        return kernels.chunk_summary(rows, limit, closes_after)

    def compose(rows: pa.Table) -> pa.Table:
        return kernels.block_summary(rows, limit, closes_after)

    def chain(batches):
        state = None
        for batch in batches:
            entries, state = kernels.chain_summaries(batch, state, limit, closes_after, "_block")
            yield entries

    def within(rows: pa.Table) -> pa.Table:
        return kernels.chain_block(rows, limit, closes_after)

    def assign(rows: pa.Table) -> pa.Table:
        return kernels.assign_groups(rows, limit, closes_after, group)

    summaries = stage(
        apart(chunked.select("_chunk", "_row", "_shard", "_weight"), "_chunk")
        .groupBy("_chunk").applyInArrow(summarize, f"_chunk long, {_STATE}")
        .withColumn("_block", F.floor(F.col("_chunk") / BLOCK_CHUNKS).cast("long")), "summaries")
    # One row per BLOCK_CHUNKS chunks, that is for every hundred million rows, meets in one task.
    blocks = (
        summaries.groupBy("_block").applyInArrow(compose, f"_block long, {_STATE}")
        .repartition(1).sortWithinPartitions("_block").mapInArrow(chain, f"_block long, {_ENTRY}")
    )
    entries = summaries.join(blocks, "_block").groupBy("_block").applyInArrow(within, f"_chunk long, {_ENTRY}")
    entered = chunked.join(stage(entries, "entries"), "_chunk")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return apart(entered, "_chunk").groupBy("_chunk").applyInArrow(assign, f"{columns}, `{group}` long")

