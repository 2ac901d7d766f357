"""Staged tables: intermediate results written once and read by several branches.

A staged table is Parquet in the cluster's shared checkpoint folder. It outlives any executor,
cuts the lineage, and unlike a cached or checkpointed DataFrame it is column-pruned, so a branch
that plans on lengths never reads the token arrays stored beside them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_areas: list[list[str]] = []


def staging_root(spark: SparkSession) -> str:
    """The shared folder of the session; a private one only for local sessions that set none."""
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    programmatic = spark.sparkContext.getCheckpointDir()
    if programmatic:
        return programmatic.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tokenloom-")
    return _local_root


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{staging_root(spark)}/tokenloom/{label}-{uuid.uuid4().hex}"
    for area in _areas:
        area.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote, wherever Spark keeps it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def staging_area(spark: SparkSession) -> Iterator[None]:
    """Owns what is staged inside the block and removes it at the end.

    Results that still read staged tables must have been written out by then.
    """
    mine: list[str] = []
    _areas.append(mine)
    try:
        yield
    finally:
        _areas.remove(mine)
        for path in mine:
            remove(spark, path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
