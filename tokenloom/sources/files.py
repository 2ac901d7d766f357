"""File discovery through Spark's own listing; no file content is read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = {"parquet": ".parquet", "jsonl": ".jsonl"}


def find_files(spark: SparkSession, paths: list[str], suffixes: list[str]) -> DataFrame:
    """Files under ``paths`` whose name ends with one of ``suffixes`` (any case), sorted by path.

    Paths may be files or folders; folders are searched recursively. A file reachable through two
    paths is listed once. Raises ``FileNotFoundError`` when nothing matches.
    """
    found = None
    for path in paths:
        try:
            listed = (
                spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
                .select("path", "length")
            )
        except AnalysisException:
            continue
        found = listed if found is None else found.unionByName(listed)
    if found is not None:
        wanted = F.lit(False)
        for suffix in suffixes:
            wanted = wanted | F.lower("path").endswith(suffix.lower())
        found = found.where(wanted).distinct()
    if found is None or found.isEmpty():
        raise FileNotFoundError(f"nothing under {paths} ends with any of {suffixes}")
    return found.orderBy("path")


def find_dataset_files(spark: SparkSession, paths: list[str], dataset_type: str) -> DataFrame:
    return find_files(spark, paths, [suffix_of(dataset_type)])


def find_parquet_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return find_dataset_files(spark, paths, "parquet")


def find_jsonl_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return find_dataset_files(spark, paths, "jsonl")


def suffix_of(dataset_type: str | None) -> str:
    if dataset_type not in SUFFIXES:
        raise ValueError("dataset_type must be one of: " + ", ".join(SUFFIXES))
    return SUFFIXES[dataset_type]
