"""Token dictionaries on disk."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """Save ``(token, id)`` as JSON lines."""
    dictionary.select("token", "id").write.json(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Read ``(token, id)`` from a saved dictionary.

    Accepts a folder written by ``write_dictionary``, a Parquet table, or a single
    ``vocab.json``-style file holding one JSON object of token to id (or a folder with that file).
    """
    try:
        if path.endswith(".json"):
            return _read_object(spark, path)
        if path.endswith(".parquet"):
            return spark.read.parquet(path).select("token", F.col("id").cast("long").alias("id"))
        try:
            return _read_object(spark, f"{path.rstrip('/')}/vocab.json")
        except AnalysisException:
            return spark.read.schema("token string, id long").json(path)
    except AnalysisException as err:
        raise FileNotFoundError(f"Token dictionary not found: {path}") from err


def _read_object(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,long>")
    return whole.select(F.explode(entries).alias("token", "id"))


def read_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The dictionary ``(token, id)`` and the merges ``(rank, left, right)`` of a tokenizer.

    ``path`` is a ``tokenizer.json`` file, or a folder with ``vocab.json`` (or a folder written by
    ``write_dictionary``) and ``merges.txt``. A file of merges starts with an optional ``#version``
    line; blank lines don't count.
    """
    if path.endswith(".json"):
        return _read_model(spark, path)
    folder = path.rstrip("/")
    return _read_folder_vocab(spark, folder), read_merges(spark, f"{folder}/merges.txt")


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """``(rank, left, right)`` from lines of two symbols, best rank first. Ranks have gaps at blank lines."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as err:
        raise FileNotFoundError(f"Merges not found: {path}") from err
    lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    is_version = (F.col("at") == 0) & F.col("line").startswith("#version")
    parts = F.split("line", " ")
    return lines.where((F.col("line") != "") & ~is_version).select(
        F.col("at").cast("long").alias("rank"), parts[0].alias("left"), parts[1].alias("right"))


def _read_folder_vocab(spark: SparkSession, folder: str) -> DataFrame:
    """``vocab.json`` as one JSON object or as a folder of JSON lines."""
    path = f"{folder}/vocab.json"
    try:
        lines = spark.read.schema("token string, id long").json(path).where("token is not null and id is not null")
        return _read_object(spark, path) if lines.isEmpty() else lines
    except AnalysisException as err:
        raise FileNotFoundError(f"Token dictionary not found: {path}") from err


def _read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as err:
        raise FileNotFoundError(f"Tokenizer not found: {path}") from err
    # Merges are pairs or, in older files, two symbols in one string; a pair arrives as its JSON text.
    model = whole.select(F.from_json("value", "model struct<vocab: map<string,long>, merges: array<string>>").alias("m"))
    vocab = model.select(F.explode("m.model.vocab").alias("token", "id"))
    merges = model.select(F.posexplode("m.model.merges").alias("at", "line"))
    is_pair = F.col("line").startswith('["')
    parts = F.when(is_pair, F.from_json("line", "array<string>")).otherwise(F.split("line", " "))
    return vocab, merges.select(F.col("at").cast("long").alias("rank"),
                                parts[0].alias("left"), parts[1].alias("right"))


def write_merges(merges: DataFrame, path: str) -> None:
    """Save merges as one ``merges.txt``-style file inside the folder ``path``."""
    lines = merges.orderBy("rank").select(F.concat_ws(" ", "left", "right").alias("value"))
    lines.coalesce(1).write.text(path)
