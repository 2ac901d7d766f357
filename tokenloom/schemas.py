"""Declared schemas of the tables that flow between operators."""

from __future__ import annotations

from pyspark.sql import types as T

IDS = T.ArrayType(T.IntegerType())

CONTENT_PART = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("image", T.StringType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("video", T.StringType()),
])

# ``arguments`` keeps the raw JSON object so that the order of its names survives.
TOOL_CALL = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("arguments", T.StringType()),
])

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("parts", T.ArrayType(CONTENT_PART)),
    T.StructField("reasoning_content", T.StringType()),
    T.StructField("tool_calls", T.ArrayType(TOOL_CALL)),
    # Set when ``content`` is neither text, a list of parts, nor absent.
    T.StructField("bad_content", T.BooleanType()),
])

EXPECTATION = T.StructType([
    T.StructField("must_include", T.ArrayType(T.StringType())),
    T.StructField("min_chars", T.LongType()),
    T.StructField("max_chars", T.LongType()),
    T.StructField("tool_call", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("args", T.StringType()),
    ])),
])
