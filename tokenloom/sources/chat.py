"""Chat samples and fine-tuning rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.operators.indexing import with_scan_index
from tokenloom.schemas import EXPECTATION, MESSAGE
from tokenloom.sources.files import suffix_of
from tokenloom.staging import stage

_RAW_CALL = "struct<name string, arguments string, function struct<name string, arguments string>>"
_RAW_MESSAGE = (
    "struct<role string, content variant, reasoning_content variant, "
    f"tool_calls array<{_RAW_CALL}>>"
)


def read_chat_samples(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Chat samples as ``(id, messages, tools, expected, list_index)``.

    ``multi_line`` reads files that hold one JSON list; without it each line is one sample.
    ``tools`` stays raw JSON text, because its key order and shape vary by sample. ``list_index`` counts
    the samples from 0 in file order; it names samples that have no id.
    """
    raw = (
        spark.read
        .schema(f"id string, messages array<{_RAW_MESSAGE}>, tools string, "
                f"expected {EXPECTATION.simpleString()}")
        .option("multiLine", multi_line)
        .option("recursiveFileLookup", True)
        .json(path)
    )
    # Within a file split generated ids count its rows one by one.
    pos = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("row")).alias("pos")
    placed = raw.select(pos, "id", F.transform("messages", normalize_message).alias("messages"), "tools", "expected")
    return with_scan_index(stage(placed, "chat-samples"), "list_index").drop("pos")


def normalize_message(m: Column) -> Column:
    """Bring a raw message to ``schemas.MESSAGE``: text or parts, calls unwrapped."""
    kind = F.schema_of_variant(m["content"])
    is_text, is_list = kind == "STRING", kind.startswith("ARRAY")
    absent = kind.isNull() | (kind == "VOID")
    parts = F.transform(F.try_variant_get(m["content"], "$", "array<variant>"), _part)
    reasoning = F.when(F.schema_of_variant(m["reasoning_content"]) == "STRING",
                       F.variant_get(m["reasoning_content"], "$", "string"))
    calls = F.transform(m["tool_calls"], lambda c: F.struct(
        F.coalesce(c["function"]["name"], c["name"]).alias("name"),
        F.when(c["function"].isNotNull(), c["function"]["arguments"])
        .otherwise(c["arguments"]).alias("arguments"),
    ))
    return F.struct(
        m["role"].alias("role"),
        F.when(is_text, F.variant_get(m["content"], "$", "string")).alias("content"),
        F.when(is_list, parts).alias("parts"),
        reasoning.alias("reasoning_content"),
        calls.alias("tool_calls"),
        (~(F.coalesce(is_text, F.lit(False)) | F.coalesce(is_list, F.lit(False)) | absent))
        .alias("bad_content"),
    ).cast(MESSAGE)


def _part(p: Column) -> Column:
    def get(name: str) -> Column:
        return F.try_variant_get(p, f"$.{name}", "string").alias(name)

    return F.struct(*[get(n) for n in ("type", "text", "image", "image_url", "video")])


SFT_TEXTS = ("prompt", "completion", "instruction", "input", "output")


def read_sft_rows(spark: SparkSession, path: str, dataset_type: str, multi_line: bool = False,
                  text_column: str = "text") -> DataFrame:
    """Fine-tuning rows: ``messages``, prompt, completion, instruction, input, output, ``text_column``.

    ``path`` is a file, a glob, or a folder searched for files of exactly the type's suffix. Columns a
    source lacks come out null. Messages keep parts, reasoning and tool calls. Other values may be of
    any scalar type and become text as the reference spells it (``True``, ``1.5``); an ``input`` of 0 or
    false counts as empty.
    """
    suffix = suffix_of(dataset_type)
    reader = spark.read.option("recursiveFileLookup", True)
    if _is_folder(spark, path):
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    names = list(dict.fromkeys([*SFT_TEXTS, text_column]))
    if dataset_type == "parquet":
        rows = reader.parquet(path)
        have = set(rows.columns)
        messages = F.from_json(F.to_json("messages"), f"array<{_RAW_MESSAGE}>") if "messages" in have \
            else F.lit(None).cast(f"array<{_RAW_MESSAGE}>")
        texts = [_scalar(F.col(f"`{n}`"), rows.schema[n].dataType).alias(n) if n in have
                 else F.lit(None).cast("string").alias(n) for n in names]
    else:
        schema = ", ".join(f"`{n}` variant" for n in names)
        rows = reader.schema(f"messages array<{_RAW_MESSAGE}>, {schema}").option("multiLine", multi_line).json(path)
        messages = F.col("messages")
        texts = [_variant_text(F.col(f"`{n}`")).alias(n) for n in names]
    given = rows.select(F.transform(messages, normalize_message).alias("messages"), *texts)
    empty = F.col("input").isin("0", "0.0", "-0.0", "False")
    return given.withColumn("input", F.when(empty, F.lit("")).otherwise(F.col("input")))


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return not any(c in path for c in "*?[{") and files.exists(target) and files.getFileStatus(target).isDirectory()


def _float_text(x: Column) -> Column:
    """A double as the shortest text that reads back, with an exponent from 1e16 and below 1e-4."""
    size = F.abs(x)
    plain = F.rtrim(x.cast("decimal(38,20)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    java = x.cast("string")
    power = F.regexp_extract(java, r"E(-?)(\d+)$", 2)
    sign = F.when(F.regexp_extract(java, r"E(-?)(\d+)$", 1) == "-", "-").otherwise("+")
    mantissa = F.regexp_replace(F.regexp_extract(java, r"^(.*)E", 1), r"\.0$", "")
    short = F.concat(mantissa, F.lit("e"), sign, F.lpad(power, F.greatest(F.lit(2), F.length(power)), F.lit("0")))
    return F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf")) \
        .when((size >= 1e16) | ((size < 1e-4) & (size > 0)), short).when(size == 0, java).otherwise(plain)


def _scalar(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(kind, T.FloatType | T.DoubleType | T.DecimalType):
        return _float_text(c.cast("double"))
    return c.cast("string")


def _variant_text(c: Column) -> Column:
    kind = F.schema_of_variant(c)
    number = (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")
    flag = F.try_variant_get(c, "$", "boolean")
    return F.when(kind == "BOOLEAN", F.when(flag, "True").otherwise("False")) \
        .when(number, _float_text(F.try_variant_get(c, "$", "double"))) \
        .when(kind != "VOID", F.try_variant_get(c, "$", "string"))
