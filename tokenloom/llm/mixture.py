"""Mixing sources to target weights.

Rows get hash-random keys and are range-sorted by (source, key). Sums per source and partition give
each partition its offset, and a running sum within the partition completes the distributed prefix sum
of sizes. A source's budget is cut exactly where that sum reaches it; a budget above the source's size
repeats the source in whole epochs first. A source of any size is spread over many partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.components import checkpointed

CYCLE = (1, 2, 3)
MOST_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked_sources(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``rank``, the source's place by code point, null last, without a one-task sort."""
    parts = checkpointed(sizes.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source"))
    numbered = parts.withColumn("place", place).join(before.drop("n"), "part")
    return numbered.withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("place") - 1).drop("part", "place", "before")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: weighted shares of all sizes, none above its limit.

    Targets that pass ``most_epochs`` times their source's size stop there, and what they leave is
    shared anew among the others by weight, until none passes.
    """
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("rank") % len(cycle) + 1).cast("int"))
    table = checkpointed(_ranked_sources(sizes).withColumn("weight", weights).withColumn("limit", F.col("source_size") * float(most_epochs)))
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, free = 0.0, None
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("limit") if free is not None else F.lit(False)
        at = table.agg(F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(F.when(full, 0).otherwise(1))).first()
        if not at[2] or at[2] == free:
            break
        free = at[2]
        level = (total - at[0]) / at[1]
    return table.select("source", "source_size", "weight", F.least("limit", F.col("weight") * F.lit(level)).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0,
                cycle: tuple[int, ...] = CYCLE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``id_col``, size, source_size, target, taken: the words of each row that the mix takes.

    The mix takes the whole part of each source's target: whole epochs, then rows in the order of
    their keys, the last one in part (its first words). Null is a source of its own, sorted last; null
    and empty texts have size 0 and give nothing. Rows with equal ids and texts share a key; which of
    them the cut falls on makes no difference. Extra columns are ignored.
    """
    plan = _plan(docs, id_col, source_col, text_col, seed, cycle, most_epochs)
    return plan.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def _reference(id_col: Column, source_col: Column, text_col: Column) -> Column:
    return F.xxhash64(id_col.cast("string"), F.lit(1), source_col.cast("string"), F.lit(2), text_col.cast("string"))


def _plan(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int = 0,
          cycle: tuple[int, ...] = CYCLE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``mix_sources`` with the rows' references."""
    key = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), key.alias("key"),
                       _reference(F.col(id_col), F.col(source_col), F.col(text_col)).alias("ref"))
    order = [F.col("source").isNull(), "source", "key", "size", "ref"]
    placed = checkpointed(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sums = checkpointed(placed.groupBy("source", "part").agg(F.sum("size").alias("n")))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    targets = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), cycle, most_epochs)
    plan = before.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        "b.source", "b.part", "b.before", "t.source_size", "t.target")
    inner = Window.partitionBy("source", "part").orderBy("key", "size", "ref").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    found = running.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.part") == F.col("p.part")))
    budget = F.floor("p.target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("before") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return found.select(F.col("r.id").alias("id"), "r.ref", "size", "source_size", "target", taken.cast("long").alias("taken"))


def first_words(text: str, n: int) -> str:
    """``text`` up to the end of its ``n``-th word."""
    import re

    for at, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text), 1):
        if at == n:
            return text[:m.end()]
    return text if n else ""


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: a copy of a row for every time it is taken, the part-taken one cut to its first words.

    Columns stay as they are. Rows equal in id, source and text stand for each other.
    """
    plan = _plan(docs, id_col, source_col, text_col, **options).where("taken > 0")
    plan = plan.groupBy(F.col("id").alias("__id"), F.col("ref").alias("__r")).agg(F.max("size").alias("__size"), F.sum("taken").alias("__taken"), F.count("*").alias("__rows"))
    marked = docs.withColumn("__ref", _reference(F.col(id_col), F.col(source_col), F.col(text_col)))
    joined = marked.join(plan, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__ref") == F.col("__r")))
    joined = joined.where("__rows = 1").unionByName(joined.where("__rows > 1").dropDuplicates(["__r", "__id"]))
    share = lambda i: F.least(F.col("__size"), F.col("__taken") - i * F.col("__size"))
    copies = F.transform(F.sequence(F.lit(0), F.ceil(F.col("__taken") / F.col("__size")).cast("int") - 1), share)
    spread = joined.withColumn("__words", F.explode(copies))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, words: pa.Array) -> pa.Array:
        return pa.array([first_words(t, n) for t, n in zip(texts.to_pylist(), words.to_pylist(), strict=True)], pa.string())

    whole = spread.where("__words = __size").select(*docs.columns)
    part = spread.where("__words < __size").withColumn(text_col, cut(F.col(text_col), F.col("__words"))).select(*docs.columns)
    return whole.unionByName(part)
