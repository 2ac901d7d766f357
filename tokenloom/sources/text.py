"""Text scans: one text column out of Parquet or JSON-lines files, batch or streaming.

Every row carries ``pos``, a sortable position (file, block, row) that stands for file order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.text import is_nonblank, strip
from tokenloom.sources.files import suffix_of

FILE = "_metadata.file_path"
JSONL = "*.[jJ][sS][oO][nN][lL]"


def scan_text(spark: SparkSession, paths: str | list[str], text_column: str,
              dataset_type: str | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scan ``text_column`` (plus ``keep``, Parquet only) from files or folders."""
    suffix_of(dataset_type)
    if not paths:
        raise ValueError("a source path is required")
    if not text_column:
        raise ValueError("a text column is required")
    if dataset_type == "parquet":
        return scan_parquet(spark, paths, text_column, keep)
    return scan_jsonl(spark, paths, text_column)


def scan_parquet(spark: SparkSession, paths: str | list[str], text_column: str,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    if isinstance(paths, list) or not paths.lower().endswith(".parquet"):
        reader = reader.option("pathGlobFilter", "*.[pP][aA][rR][qQ][uU][eE][tT]")
    files = reader.parquet(*([paths] if isinstance(paths, str) else paths))
    pos = F.struct(F.col(FILE).alias("file"), F.lit(0).cast("long").alias("block"),
                   F.col("_metadata.row_index").alias("row")).alias("pos")
    return files.select(pos, *keep, text_column)


def scan_jsonl(spark: SparkSession, paths: str | list[str], text_column: str) -> DataFrame:
    """Rows of JSON-lines files whose ``text_column`` is a non-blank JSON string."""
    return parse_jsonl(scan_lines(spark, paths), text_column)


def scan_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Stripped non-blank lines. Sharding by line number applies to these, before any parsing."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", JSONL)
        .text([paths] if isinstance(paths, str) else paths)
    )
    lines = files.select(
        F.col(FILE).alias("file"), F.col("_metadata.file_block_start").alias("block"),
        strip(F.col("value")).alias("line"),
    ).where(is_nonblank(F.col("line")))
    # Within one file split the generated id counts the kept lines one by one; splits are told
    # apart by their start offset, so the struct sorts in file order however splits are laid out.
    pos = F.struct("file", "block", F.monotonically_increasing_id().alias("row")).alias("pos")
    return lines.select(pos, "line")


def parse_jsonl(lines: DataFrame, text_column: str, line_column: str = "line") -> DataFrame:
    """Strict per-line JSON: malformed lines, other JSON types and non-string texts are dropped.

    A line must hold exactly one JSON object. It is parsed as the first item of a two-item list
    whose second item is a marker, so anything trailing the object breaks the expected shape.
    """
    field = "`" + text_column.replace("`", "``") + "`"
    mark = "__line_end"
    rows = F.from_json(
        F.concat(F.lit("["), F.col(line_column), F.lit(f',{{"{mark}":1}}]')),
        f"array<struct<{field} variant, {mark} int>>",
        {"allowSingleQuotes": "false"},
    )
    value = F.col("_rows")[0][text_column]
    whole = (F.size("_rows") == 2) & (F.col("_rows")[1][mark] == 1) & F.col("_rows")[0][mark].isNull()
    others = [c for c in lines.columns if c != line_column]
    # A generator's output is a column of its own: conditions on it do not parse the line again.
    parsed = lines.select(*others, F.explode(F.array(rows)).alias("_rows"))
    kept = parsed.where(whole & (F.schema_of_variant(value) == "STRING"))
    texts = kept.select(*others, F.explode(F.array(F.variant_get(value, "$", "string"))).alias("_text"))
    return texts.where(is_nonblank(F.col("_text"))).withColumnRenamed("_text", text_column)


def stream_text(spark: SparkSession, path: str, text_column: str, dataset_type: str | None,
                schema: T.StructType | None = None, max_files_per_trigger: int | None = None,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Unbounded scan of a folder. Parquet needs ``schema``; JSON lines always yield the text."""
    suffix_of(dataset_type)
    reader = spark.readStream.option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if dataset_type == "parquet":
        if schema is None:
            raise ValueError("a Parquet stream needs its schema")
        return reader.schema(schema).parquet(path).select(*keep, text_column)
    lines = reader.option("pathGlobFilter", JSONL).text(path).select(strip(F.col("value")).alias("line"))
    return parse_jsonl(lines.where(is_nonblank(F.col("line"))), text_column)
