"""Session defaults for local runs (tests and bench); clusters bring their own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


BATCH_ROWS = 4000


def text_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most ``BATCH_ROWS`` rows in this session.

    Spark's 10,000 are made for numbers. That many texts, cut into pieces, would stand several times in the memory
    of each Python worker, and whether a batch gets so large depends on how much input a task has.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tokenloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
