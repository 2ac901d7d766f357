"""Packing units into samples of fixed capacity.

Windows and bins are decided on unit lengths; token arrays are only touched when the samples are
put together.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom import kernels
from tokenloom.functions.arrays import IGNORE_LABEL, PAD_POSITION, numbers, pad_to, positions
from tokenloom.operators.chunk import split_units
from tokenloom.operators.grouping import close_on_overflow, close_on_reach
from tokenloom.operators.guards import min_unit
from tokenloom.operators.indexing import apart
from tokenloom.sources.special import resolve_pad_id
from tokenloom.staging import stage

ROW = "_number"


def assign_windows(rows: DataFrame, *, window_units: int, shard: str, order: list[str],
                   count: str = "n_units", chunk_rows: int | None = None) -> DataFrame:
    """Add ``window_id`` to rows that hold ``n_units`` units each, in order within their shard.

    A window closes after the row that fills it to ``window_units``; the next starts empty.
    """
    return close_on_reach(rows, shard, order, count, max(1, window_units), "window_id", chunk_rows)


def pack_windows(units: DataFrame, *, capacity: int, min_len: int, shard: str,
                 order: list[str]) -> DataFrame:
    """Best-fit-decreasing bins per window: adds ``bin`` and ``slot`` to ``len`` rows.

    Units outside ``min_len .. capacity`` are left out, as are bins below ``min_len``. A window
    is bounded by its unit count, so each group is small; the many windows spread over tasks.
    """
    low = min_unit(min_len)
    keep = [shard, "window_id", *[c for c in order if c != shard], "len"]
    fitting = units.select(*dict.fromkeys(keep)).where(F.col("len").between(low, capacity))

    def pack(rows: pa.Table) -> pa.Table:
        return kernels.pack_window(rows, order, capacity)

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fitting.schema)
    windows = apart(fitting, shard, "window_id").groupBy(shard, "window_id")
    return windows.applyInArrow(pack, f"{columns}, bin int, slot int")


def pack_sequential(units: DataFrame, *, capacity: int, shard: str, order: list[str],
                    chunk_rows: int | None = None) -> DataFrame:
    """Baseline packer: units in order, a new bin whenever the next one does not fit.

    Units longer than ``capacity`` are skipped.
    """
    return close_on_overflow(units.where(F.col("len") <= capacity), shard, order, "len", capacity,
                             "bin", chunk_rows)


def build_samples(units: DataFrame, assignment: DataFrame, *, key: list[str],
                  sample: list[str], order: list[str]) -> DataFrame:
    """Concatenate the units of every bin: ``input_ids``, ``labels``, ``position_ids``, ``segments``.

    ``units`` has ``key`` and ``input_ids``; ``assignment`` has ``key``, the ``sample`` columns and
    the ``order`` of units inside a sample. Token arrays move once for the join (not at all when
    the assignment is small enough for Spark to broadcast it) and once to meet their bin.
    """
    placed = units.select(*key, "input_ids").join(assignment.select(*{*key, *sample, *order}), key)
    rank = F.struct(*order).alias("at")
    # Units of a bin are scattered, collecting them ahead of the shuffle would only cost memory.
    grouped = placed.repartition(*sample).groupBy(*sample).agg(F.sort_array(F.collect_list(
        F.struct(rank, F.col("input_ids").alias("ids")))).alias("_units"))
    built = grouped.select(
        *sample,
        F.flatten("_units.ids").alias("input_ids"),
        F.transform("_units", lambda u: F.size(u["ids"])).alias("_lens"),
    ).withColumn("position_ids", positions(F.col("_lens")))
    return built.select(*sample, "input_ids", F.col("input_ids").alias("labels"), "position_ids",
                        _segments().alias("segments"))


def _segments():
    """Interval of every unit in its sample; units begin where positions restart."""
    starts = F.array_compact(F.transform("position_ids", lambda p, i: F.when(p == 0, i)))
    return F.transform(
        F.arrays_zip(starts.alias("start"), F.col("_lens").alias("len")),
        lambda u, i: F.struct(i.alias("unit_idx"), u["start"].alias("start"), u["len"].alias("len")),
    )


def unit_segments(lens: Column) -> Column:
    """Interval of every unit of a sample from the units' lengths."""
    ends = F.transform(lens, lambda n, i: F.aggregate(F.slice(lens, F.lit(1), i + 1), F.lit(0), lambda a, b: a + b))
    return F.transform(lens, lambda n, i: F.struct(i.alias("unit_idx"), (F.get(ends, i) - n).alias("start"), n.alias("len")))


def pad_samples(samples: DataFrame, block_size: int, pad_id: int) -> DataFrame:
    """Cut or pad every sample to ``block_size``; adds ``attention_mask``.

    Missing labels default to the ids, missing positions to 0 .. n-1.
    """
    ids = F.col("input_ids")
    labels = ids if "labels" not in samples.columns else F.coalesce("labels", ids)
    own = numbers(F.size(ids))
    pos = own if "position_ids" not in samples.columns else F.coalesce("position_ids", own)
    width = F.lit(block_size)
    n = F.least(F.size(ids), width)
    replaced = {"input_ids", "labels", "position_ids", "attention_mask"}
    return samples.select(
        *[c for c in samples.columns if c not in replaced],
        pad_to(ids, n, width, pad_id).alias("input_ids"),
        pad_to(labels, n, width, IGNORE_LABEL).alias("labels"),
        pad_to(pos, n, width, PAD_POSITION).alias("position_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), width - n))
        .alias("attention_mask"),
    )


def packed_dataset(encoded: DataFrame, *, seq_len: int, window_units: int | None = None,
                   capacity: int | None = None, min_len: int = 2, pad_id: int | None = None,
                   eos_id: int | None = None, shard: str, key: str, order: str | None = None,
                   chunk_rows: int | None = None, skip_long: bool = False) -> DataFrame:
    """Rows of ``ids`` (end id appended) to padded samples ``(shard, window_id, bin, ...)``.

    ``window_units`` and ``capacity`` default to each other, then to ``seq_len``. A capacity below
    ``seq_len`` would lose every longer unit, so it needs ``skip_long``; ``left_out`` counts such units.
    Rows are numbered when they are staged and meet their windows by that number: ``key``,
    ``order`` and ``shard`` may be null or repeat. Without ``pad_id`` samples are padded with ``eos_id``.
    """
    pad_id = resolve_pad_id(pad_id, eos_id)
    capacity = capacity or window_units or seq_len
    window_units = window_units or capacity
    if capacity < seq_len and not skip_long:
        raise ValueError(f"units of up to {seq_len} tokens do not fit a capacity of {capacity}")
    order = order or key
    columns = list(dict.fromkeys([shard, key, order]))
    rows = encoded.select(*columns, "ids").withColumn(ROW, F.monotonically_increasing_id())
    units = stage(split_units(rows, seq_len, min_len), "units")
    windows = assign_windows(first_units(units, [*columns, ROW]), window_units=window_units, shard=shard,
                             order=[order, ROW], chunk_rows=chunk_rows)
    return pack_units(units, windows, capacity=capacity, min_len=min_len, pad_id=pad_id,
                      shard=shard, key=ROW, order=order)


def left_out(units: DataFrame, capacity: int, min_len: int = 2) -> DataFrame:
    """One row: how many units, and tokens in them, a packer of that capacity leaves out."""
    outside = ~F.col("len").between(min_unit(min_len), capacity)
    return units.where(outside).agg(F.count("*").alias("units"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("tokens"))


def first_units(units: DataFrame, columns: list[str]) -> DataFrame:
    """One row per source row of a unit table, without its tokens."""
    return units.where(F.col("block_no") == 0).select(*columns, "n_units")


def pack_units(units: DataFrame, windows: DataFrame, *, capacity: int, min_len: int, pad_id: int,
               shard: str, key: str, order: str) -> DataFrame:
    """Padded samples of the units whose rows have a window."""
    lengths = units.select(key, "block_no", "len")
    assignment = plan_bins(windows, lengths, capacity=capacity, min_len=min_len, shard=shard,
                           key=key, order=order)
    samples = build_samples(units, assignment, key=[key, "block_no"],
                            sample=[shard, "window_id", "bin"], order=["slot"])
    return pad_samples(samples, capacity, pad_id)


def plan_bins(windows: DataFrame, lengths: DataFrame, *, capacity: int, min_len: int, shard: str,
              key: str, order: str) -> DataFrame:
    """``(shard, window_id, key, block_no, len, bin, slot)`` from lengths alone."""
    placed = windows.select(*{shard, key, order}, "window_id").join(lengths, key)
    unit_order = list(dict.fromkeys([order, key, "block_no"]))
    return pack_windows(placed, capacity=capacity, min_len=min_len, shard=shard, order=unit_order)


def sample_lengths(assignment: DataFrame, sample: list[str], min_len: int = 2) -> DataFrame:
    """Token count of every sample from the plan; samples below ``min_len`` are left out."""
    return (
        assignment.groupBy(*sample)
        .agg(F.count("*").alias("n_units"), F.sum("len").alias("n_tokens"))
        .where(F.col("n_tokens") >= min_unit(min_len))
    )


def summarize(samples: DataFrame, capacity: int, strategy: str,
              length: str = "n_tokens") -> DataFrame:
    """One row: samples, tokens, capacity, utilization (0 when empty)."""
    room = F.col("total_capacity")
    return (
        samples.agg(F.count("*").alias("samples"),
                    F.coalesce(F.sum(length), F.lit(0)).cast("long").alias("total_tokens"))
        .withColumn("total_capacity", F.col("samples") * capacity)
        .select(
            F.lit(strategy).alias("strategy"), "samples", "total_tokens", "total_capacity",
            F.when(room > 0, F.col("total_tokens") / room).otherwise(0.0).alias("utilization"),
        )
        .withColumn("shown", F.format_string("%.2f%%", F.col("utilization") * 100))
    )


def first_samples(samples: DataFrame, order: list[str], count: int = 10) -> DataFrame:
    """The report's leading samples."""
    return samples.orderBy(*order).limit(count)


def compare(*summaries: DataFrame) -> DataFrame:
    """Summaries of several packers side by side."""
    out = summaries[0]
    for other in summaries[1:]:
        out = out.unionByName(other)
    return out


def synthetic_units(numbers_df: DataFrame, n: str, eos_id: int) -> DataFrame:
    """For every row's number n: n copies of n, then the end id."""
    value = F.col(n).cast("int")
    ids = F.concat(F.array_repeat(value, value), F.array(F.lit(eos_id)))
    return numbers_df.select(n, ids.alias("input_ids")).withColumn("len", F.size("input_ids"))
