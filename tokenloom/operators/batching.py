"""Batches, dynamic padding, and the training step plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.functions.arrays import IGNORE_LABEL, PAD_POSITION, numbers, pad_to
from tokenloom.operators.indexing import join_on, permuted, shuffle_key, with_group_index, with_row_index, with_running_sum
from tokenloom.operators.masks import dense_mask
from tokenloom.sources.special import resolve_pad_id
from tokenloom.staging import stage


def assign_batches(rows: DataFrame, batch_size: int, order: list[str], shard: str | None = None,
                   shuffle_seed: int | None = None) -> DataFrame:
    """Add ``batch_id`` and ``row_in_batch``; the last batch of a shard may be short.

    With ``shuffle_seed`` the order is a repeatable shuffle of ``order`` instead. Give this the key
    columns and lengths, not the token arrays; ``collate`` joins those on.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    if shuffle_seed is not None:
        rows = rows.withColumn("_shuffle", shuffle_key(order, shuffle_seed))
        order = ["_shuffle", *order]
    if shard is None:
        indexed = with_row_index(rows, order, "_n")
    else:
        indexed = with_group_index(rows, shard, order, "_n")
    return indexed.select(
        *[c for c in rows.columns if c != "_shuffle"],
        F.floor(F.col("_n") / batch_size).cast("long").alias("batch_id"),
        (F.col("_n") % batch_size).cast("int").alias("row_in_batch"),
    )


def permute_batches(rows: DataFrame, batch_size: int, index: str, n: int, seed: int) -> DataFrame:
    """Shuffled ``batch_id`` and ``row_in_batch`` of rows numbered 0 .. n-1 in ``index``, without moving a row.

    The order is a seeded permutation of the numbers, so it repeats, and no hash is sorted.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    placed = rows.withColumn("_to", permuted(F.col(index), n, seed))
    return placed.select(
        *rows.columns, F.call_function("div", F.col("_to"), F.lit(batch_size)).alias("batch_id"),
        (F.col("_to") % batch_size).cast("int").alias("row_in_batch"))


def stage_cut(rows: DataFrame, order: list[str], budgets: list[tuple[str, int]], length: str = "len") -> DataFrame:
    """``rows`` dealt to training stages whose token budgets are used up one after another.

    Adds ``stage``, ``start`` and ``take``: a row gives ``take`` tokens from ``start`` on. The row on which a budget ends is cut
    there and its rest opens the next stage; rows behind the last budget, and those without tokens, are left out.
    """
    if any(tokens < 0 for _, tokens in budgets):
        raise ValueError("budgets must not be negative")
    summed = with_running_sum(rows, order, length, "_before")
    before, after = F.col("_before"), F.col("_before") + F.col(length)
    parts, low = [], 0
    for name, tokens in budgets:
        start = F.greatest(before, F.lit(low))
        take = F.least(after, F.lit(low + tokens)) - start
        parts.append(F.struct(F.lit(name).alias("stage"), (start - before).cast("long").alias("start"), take.cast("long").alias("take")))
        low += tokens
    dealt = F.filter(F.array(*parts), lambda p: p["take"] > 0)
    return summed.where(before < low).select(*rows.columns, F.explode(dealt).alias("_s")).select(*rows.columns, "_s.*")


def stage_plan(cut: DataFrame, tokens_per_update: int) -> DataFrame:
    """Rows, tokens and optimizer updates of each stage of a ``stage_cut``."""
    found = cut.groupBy("stage").agg(F.count("*").alias("rows"), F.sum("take").cast("long").alias("tokens"))
    return found.withColumn("updates", F.ceil(F.col("tokens") / tokens_per_update).cast("long"))


def training_batches(samples: DataFrame, batch_size: int, *, key: list[str], pad_id: int | None = None,
                     eos_id: int | None = None, shard: str | None = None, shuffle_seed: int | None = None,
                     use_block_diag_mask: bool = False) -> DataFrame:
    """Samples in the order of ``key`` (or shuffled) to padded batch rows.

    Rows are numbered when they are staged, and meet their batch by that number: ``key`` may repeat
    or be null, and so may ``shard``. Without ``pad_id`` rows are padded with ``eos_id``.
    """
    pad_id = resolve_pad_id(pad_id, eos_id)
    shards = [shard] if shard else []
    columns = list(dict.fromkeys([*shards, *key]))
    length = F.col("len") if "len" in samples.columns else F.size("input_ids")
    samples = stage(samples.withColumn("len", length).withColumn("_number", F.monotonically_increasing_id()), "samples")
    lengths = samples.select(*columns, "_number", "len")
    batches = assign_batches(lengths, batch_size, [*key, "_number"], shard, shuffle_seed)
    carried = [c for c in columns if c not in (*shards, "_number")]
    plan = batches.select("_number", *shards, "batch_id", "row_in_batch", "len")
    out = collate(samples.drop(*shards), plan, key=["_number"], batch=[*shards, "batch_id"], pad_id=pad_id,
                  use_block_diag_mask=use_block_diag_mask, carry=carried)
    return out.drop("_number")


def collate(samples: DataFrame, batches: DataFrame, *, key: list[str], batch: list[str],
            pad_id: int, use_block_diag_mask: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Pad the samples of each batch to its longest one.

    ``batches`` holds ``key``, ``batch`` columns, ``row_in_batch`` and ``len``. The batch maximum
    is taken on lengths (a batch is a bounded group), then one join brings the arrays; nulls in ``key``
    meet each other. ``key`` must tell the samples apart. With ``use_block_diag_mask`` the
    attention mask becomes a boolean matrix per sample.
    """
    longest = F.max("len").over(W.partitionBy(*batch)).cast("int")
    plan = batches.select(*dict.fromkeys([*key, *batch]), "row_in_batch", longest.alias("max_len"))
    rows = join_on(samples, plan, key)
    ids = F.col("input_ids")
    n = F.size(ids)
    width = F.col("max_len")
    labels = F.coalesce("labels", ids) if "labels" in samples.columns else ids
    own = numbers(n)
    pos = F.coalesce("position_ids", own) if "position_ids" in samples.columns else own
    out = rows.select(
        *batch, "row_in_batch", *[k for k in key if k not in batch], *(carry or []), "max_len",
        pad_to(ids, n, width, pad_id).alias("input_ids"),
        pad_to(F.slice(labels, F.lit(1), n), F.least(n, F.size(labels)), width, IGNORE_LABEL)
        .alias("labels"),
        pad_to(F.slice(pos, F.lit(1), n), F.least(n, F.size(pos)), width, PAD_POSITION)
        .alias("position_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), width - n))
        .alias("attention_mask"),
    )
    if use_block_diag_mask:
        out = dense_mask(out, out="attention_mask")
    return out


def step_plan(rows: DataFrame, order: list[str], *, batch_size: int, accumulation: int,
              processes: int = 1, max_steps: int | None = None, length: str = "len",
              token_budget: int | None = None) -> DataFrame:
    """Optimizer updates: rows and tokens per step, over all rows.

    A step consumes ``batch_size * accumulation * processes`` rows. With ``max_steps`` each step says
    whether a trainer that stops there gets to it, with ``token_budget`` whether it reaches the budget.
    """
    per_step = batch_size * accumulation * processes
    steps = (
        with_row_index(rows.select(*order, length), order, "_n")
        .select(F.floor(F.col("_n") / per_step).cast("long").alias("step"), length)
        .groupBy("step")
        .agg(F.count("*").alias("rows"), F.sum(length).cast("long").alias("tokens"))
    )
    if max_steps is not None:
        steps = steps.withColumn("reached", F.col("step") < max_steps)
    if token_budget is not None:
        steps = steps.withColumn("meets_budget", F.col("tokens") >= token_budget)
    return steps
