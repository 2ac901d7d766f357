"""Connected components by alternating star contractions, all in joins and aggregations."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.staging import new_path, remove


def checkpointed(df: DataFrame, free: bool = False) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    ``free`` asks for the files of the shuffles behind it at once, instead of at some later collection.
    """
    return owned(df, free)[0]


def owned(df: DataFrame, free: bool = False) -> tuple[DataFrame, Callable[[], None]]:
    """Like ``checkpointed``, and what deletes the folder once the last reader has been written."""
    spark = df.sparkSession
    path = new_path(spark, "llm")
    df.write.parquet(path)
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path), lambda: remove(spark, path)


BATCH_ROWS = 2000


def text_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most ``BATCH_ROWS`` rows in this session.

    Spark's 10,000 are made for numbers; that many texts would stand several times in an executor's
    memory, in the JVM and in Python.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def row_reference(id_col: Column, text_col: Column) -> Column:
    """A 64-bit hash of a row's id and text; rows that share both share results too."""
    return F.xxhash64(id_col.cast("string"), F.lit(1), text_col.cast("string"))


ROWS_PER_FILE = 500_000


def _open_links(edges: DataFrame) -> tuple[int, int]:
    """Number of links, and how many keep the links from being stars already.

    In stars every lower node has no link downward and every upper node has one link.
    """
    up = edges.groupBy("a").agg(F.count("*").alias("n")).select(F.col("a").alias("node"), "n", F.lit(0).alias("low"))
    down = edges.select(F.col("b").alias("node")).distinct().select("node", F.lit(0).alias("n"), F.lit(1).alias("low"))
    nodes = up.unionByName(down).groupBy("node").agg(F.sum("n").alias("n"), F.max("low").alias("low"))
    row = nodes.agg(F.sum("n").alias("all"), F.sum(F.when((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("low") > 0)), 1).otherwise(0)).alias("open")).first()
    return row["all"] or 0, row["open"] or 0


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (a, b): root is the component's smallest node.

    Nodes may be of any sortable type. Each round hangs larger neighbours on the smallest one (large
    star), then smaller neighbours likewise (small star); rounds end when all links form stars, after a
    number logarithmic in the component sizes. No links give no rows; nulls are not links.
    """
    edges, forget = owned(_oriented_structs(links))
    while True:
        size, left = _open_links(edges)
        if not left:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.when(F.col("m") < F.col("a"), F.col("m")).otherwise(F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select("a", F.col("m").alias("b")))
        small = small.where(F.col("a") != F.col("b")).distinct()
        # never more links than before, so a bounded number of rows a file
        before = forget
        edges, forget = owned(small.coalesce(2 * size // ROWS_PER_FILE + 1))
        before()
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _oriented_structs(links: DataFrame) -> DataFrame:
    """Larger end first; greatest() does not take every type that can be compared."""
    up = F.col("a") > F.col("b")
    return links.where(F.col("a") != F.col("b")).select(
        F.when(up, F.col("a")).otherwise(F.col("b")).alias("a"),
        F.when(up, F.col("b")).otherwise(F.col("a")).alias("b")).distinct()
