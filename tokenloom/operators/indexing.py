"""Global row numbers, shards and deterministic shuffles without a single-task sort."""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tokenloom.functions.arrays import let
from tokenloom.staging import stage

_ROW_BITS = (1 << 33) - 1


def with_row_index(df: DataFrame, order: list[Column | str], name: str = "row_idx",
                   partitions: int | None = None) -> DataFrame:
    """Add the zero-based global position of every row under ``order``.

    Rows are range-partitioned on the whole ordering key and sorted in place; a row's number is
    its place in its partition plus the rows in the partitions before it. The ranged rows are
    staged, which fixes them for both the counting and the numbering pass. Only the per-partition
    counts (one row per partition) meet in one place. ``order`` should be unique, so that a hot
    leading value spreads over many partitions.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = (
        df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    )
    placed = stage(
        ranged.sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))),
        "ranged",
    )
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = (
        placed.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(before, F.lit(0)).cast("long").alias("_offset"))
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_part", "_place", "_offset")
    )


def with_running_sum(df: DataFrame, order: list[Column | str], value: str, name: str = "before",
                     partitions: int | None = None) -> DataFrame:
    """Add the sum of ``value`` over all rows that stand before a row under ``order``.

    A distributed prefix sum: sums inside each range partition, plus those of the partitions before it, of which
    one row each meets in one place. Null values count as 0.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = stage(
        ranged.sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id()), "summed")
    weight = F.coalesce(F.col(value), F.lit(0)).cast("long")
    ahead = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = placed.groupBy("_part").agg(F.sum(weight).alias("_n")).select("_part", F.coalesce(ahead, F.lit(0)).alias("_offset"))
    inside = F.sum(weight).over(W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, -1))
    return (
        placed.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_inside")).drop("_part", "_place", "_offset", "_inside")
    )


def permuted(index: Column, n: int, seed: int, rounds: int = 4) -> Column:
    """A seeded permutation of 0 .. n-1 applied to ``index``, as arithmetic on the number alone.

    Feistel rounds on the two digits of a number in base ``ceil(n / side)``, where side * base is the least such product
    from n on. What lands at n or above is permuted again until it doesn't; fewer than ``side`` numbers do.
    """
    side, base, keys = permutation_keys(n, seed, rounds)
    if n < 2:
        return index.cast("long")

    def once(x: Column) -> Column:
        left, right = F.call_function("div", x, F.lit(base)), F.pmod(x, F.lit(base)).cast("long")
        for a, b, c, d in keys:
            left = F.pmod(left + F.pmod(right * a + b, F.lit(PRIME)), F.lit(side))
            right = F.pmod(right + F.pmod(left * c + d, F.lit(PRIME)), F.lit(base))
        return left * base + right

    first = let(index.cast("long"), once)
    walks = F.sequence(F.lit(1), F.lit(max(side * base - n, 1)))
    return let(first, lambda x: F.when(x < n, x).otherwise(
        F.aggregate(walks, x, lambda at, _: F.when(at < n, at).otherwise(let(at, once)))))


PRIME = (1 << 31) - 1


def permutation_keys(n: int, seed: int, rounds: int = 4) -> tuple[int, int, list[tuple[int, int, int, int]]]:
    """(side, base, round keys) of ``permuted``; n up to 2^60, so that no product passes 64 bits."""
    if not 0 <= n <= 1 << 60:
        raise ValueError("n must be between 0 and 2^60")
    side = max(math.isqrt(max(n - 1, 0)) + 1, 1)
    rng = random.Random(seed)
    keys = [tuple(rng.randrange(1, 1 << 30) for _ in range(4)) for _ in range(rounds)]
    return side, max(-(-n // side), 1), keys


def with_group_index(df: DataFrame, group: str, order: list[str], name: str = "row_idx",
                     partitions: int | None = None) -> DataFrame:
    """Zero-based position of every row inside its ``group``.

    A group's rows are numbered by subtracting the group's smallest global number, so a group
    holding a large share of the table is still spread over tasks.
    """
    indexed = with_row_index(df, [group, *order], "_global", partitions)
    first = indexed.groupBy(group).agg(F.min("_global").alias("_first"))
    return (
        indexed.join(first.withColumnRenamed(group, "_group"),
                     F.col(group).eqNullSafe(F.col("_group")))
        .withColumn(name, F.col("_global") - F.col("_first"))
        .drop("_global", "_first", "_group")
    )


def with_scan_index(rows: DataFrame, name: str = "row_idx", pos: str = "pos",
                    max_broadcast: int = 500_000) -> DataFrame:
    """Zero-based number of every row of a file scan, in file order, without moving any row.

    Counts the rows of each file split, sums the counts in split order (one small row per split),
    and adds a row's place in its split. Takes a scan's output as it is: rows filtered out after
    the scan would leave gaps, which fail the job.
    """
    at = F.col(pos)
    counted = stage(
        rows.groupBy(at["file"].alias("_file"), at["block"].alias("_block"))
        .agg(F.min(at["row"]).alias("_first"), F.max(at["row"]).alias("_last"),
             F.count("*").alias("_n")),
        "splits",
    )
    before = F.sum("_n").over(W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1))
    dense = F.col("_last") - F.col("_first") + 1 == F.col("_n")
    gap = F.raise_error(F.lit("rows were removed between the scan and its numbering")).cast("long")
    offsets = counted.select(
        "_file", "_block",
        F.when(dense, F.coalesce(before, F.lit(0)) - F.col("_first")).otherwise(gap).alias("_offset"))
    if counted.count() <= max_broadcast:
        offsets = F.broadcast(offsets)
    return (
        rows.join(offsets, (at["file"] == F.col("_file")) & (at["block"] == F.col("_block")))
        .withColumn(name, F.col("_offset") + at["row"])
        .drop("_file", "_block", "_offset")
    )


def shard_scan(rows: DataFrame, num_shards: int, name: str = "shard", pos: str = "pos") -> DataFrame:
    """Exact round-robin over a scan in file order, such as JSON lines before parsing."""
    _at_least_one(num_shards)
    return (
        with_scan_index(rows, "_n", pos)
        .withColumn(name, F.pmod("_n", F.lit(num_shards)).cast("int")).drop("_n")
    )


def reader_shard(rank: int, worker: int, workers: int, world_size: int) -> tuple[int, int]:
    """(shard, number of shards) of one loader worker of one process."""
    return rank * workers + worker, world_size * workers


def shard_by_position(df: DataFrame, order: list[str], num_shards: int,
                      name: str = "shard") -> DataFrame:
    """Exact round-robin: the n-th row under ``order`` goes to shard ``n % num_shards``.

    Whole rows are range-sorted, so that order keys may be null or repeat.
    """
    _at_least_one(num_shards)
    indexed = with_row_index(df, order, "_n")
    return indexed.withColumn(name, F.pmod("_n", F.lit(num_shards)).cast("int")).drop("_n")


def join_on(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` in which nulls meet nulls; key columns come from the left."""
    names = {k: f"_right_{k}" for k in key}
    other = right.withColumnsRenamed(names)
    same = reduce(Column.__and__, [left[k].eqNullSafe(other[n]) for k, n in names.items()])
    return left.join(other, same, how).drop(*names.values())


def shard_by_hash(df: DataFrame, key: list[str], num_shards: int,
                  name: str = "shard") -> DataFrame:
    """Order-free sharding: narrow, no shuffle."""
    _at_least_one(num_shards)
    return df.withColumn(name, F.pmod(F.xxhash64(*key), F.lit(num_shards)).cast("int"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Redistribute a small scan that would leave cores idle; larger scans pass unchanged.

    The decision looks at the number of input files only. With at least one file per core there is no
    shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, key)


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the session's full number of shuffle partitions.

    For grouped Python work: its rows are few bytes but much work, and a partition count chosen
    by bytes would put all groups into one task. Grouping by ``keys`` adds no further shuffle.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)


def shuffle_key(key: list[str], seed: int) -> Column:
    """Sort key of a repeatable shuffle; unlike a random number it survives task retries."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))


def _at_least_one(num_shards: int) -> None:
    if num_shards < 1:
        raise ValueError("num_shards must be at least 1")
