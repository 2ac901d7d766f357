"""Inputs of the registered queries: the given tables, and rows derived from all of them."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.chat import message
from tokenloom.operators.indexing import spread

SEQ_LEN = 256
MIN_LEN = 2
WINDOW_UNITS = 64
CAPACITY = 1024
EOS_ID = 0
PAD_ID = 0
BATCH = 16
# A public tokenizer's file; any other can be set in its place.
TOKENIZER = os.environ.get("TOKENLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
SHARDS = 8
SMALL_HEAD = 50
STAGE_BUDGETS = [("general", 20_000), ("stem", 20_000), ("long", 150)]
SMALL_CHUNK = 97


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf}/documents.parquet").select(*columns)
    return spread(scan, "doc_id")


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet")


def text_variants(docs: DataFrame) -> DataFrame:
    """Every document as is, and with its text replaced by each kind of blank or near-blank."""
    kinds = {
        "empty": "", "spaces": "   ", "breaks": "\t\n\r", "wide": "\xa0\u3000",
        "controls": "\x1c\x85", "zero_width": "\u200b", "none": None,
    }
    rows = [F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"))]
    rows += [F.struct(F.lit(k).alias("kind"), F.lit(v).cast("string").alias("text"))
             for k, v in kinds.items()]
    return docs.select("doc_id", F.explode(F.array(*rows)).alias("v")).select("doc_id", "v.*")


def json_lines(docs: DataFrame, events: DataFrame) -> DataFrame:
    """JSON lines in every shape a reader meets, built from documents and event properties."""
    doc = F.col("doc_id").cast("string")
    good = F.to_json(F.struct(F.col("doc_id").alias("doc"), F.col("text").alias("text")))
    lines = {
        "good": good,
        "padded": F.concat(F.lit(" \t"), good, F.lit("  ")),
        "number": F.concat(F.lit('{"doc":'), doc, F.lit(',"text":5}')),
        "null": F.concat(F.lit('{"doc":'), doc, F.lit(',"text":null}')),
        "blank": F.concat(F.lit('{"doc":'), doc, F.lit(',"text":"  "}')),
        "absent": F.concat(F.lit('{"doc":'), doc, F.lit("}")),
        "nested": F.concat(F.lit('{"text":{"text":'), doc, F.lit("}}")),
        "list": F.concat(F.lit("["), good, F.lit("]")),
        "cut": F.substring(good, F.lit(1), F.length(good) - 1),
        "twice": F.concat(good, F.lit(" "), good),
        "bare": doc,
    }
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("line")) for k, v in lines.items()])
    from_docs = docs.select(F.col("doc_id").alias("row_id"), F.explode(rows).alias("v"))
    props = F.col("props")
    with_text = F.concat(F.lit('{"text":"event '), F.col("event_id").cast("string"), F.lit('",'),
                         F.substring(props, F.lit(2), F.length(props)))
    both = F.array(F.struct(F.lit("props").alias("kind"), props.alias("line")),
                   F.struct(F.lit("event").alias("kind"), with_text.alias("line")))
    from_events = events.select(F.col("event_id").alias("row_id"), F.explode(both).alias("v"))
    return from_docs.unionByName(from_events).select("row_id", "v.*")


def sft_rows(docs: DataFrame) -> DataFrame:
    """Every document as one fine-tuning row; its number decides which of six shapes it takes."""
    shape = F.pmod("doc_id", F.lit(6))
    text, lang, source = F.col("text"), F.col("lang"), F.col("source")

    def at(k: int, value):
        return F.when(shape == k, value)

    turns = F.array(F.struct(F.lit("user").alias("role"), source.alias("content")),
                    F.struct(F.lit("assistant").alias("role"), text.alias("content")))
    none = F.array().cast("array<struct<role:string,content:string>>")
    return docs.select(
        "doc_id",
        at(0, turns).when(shape == 1, none).alias("messages"),
        F.when(shape.isin(0, 1), lang).alias("prompt"),
        F.when(shape.isin(0, 1), text).alias("completion"),
        F.when(shape.isin(2, 3), lang).alias("instruction"),
        at(2, source).when(shape == 3, F.lit("")).alias("input"),
        F.when(shape.isin(2, 3), text).alias("output"),
        at(4, text).alias("text"),
    )


def rich_sft_rows(docs: DataFrame) -> DataFrame:
    """Every document as a row of one of four shapes that hold more than plain strings."""
    shape = F.pmod("doc_id", F.lit(4))
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    call = F.struct(F.struct(F.lit("find").alias("name"),
                             F.struct(F.col("doc_id").alias("id"), F.lit(True).alias("deep")).alias("arguments")).alias("function"))
    none = F.lit(None)
    user = F.struct(F.lit("user").alias("role"), F.array(part("text", F.col("source")), part("text", F.lit(" asks"))).alias("content"),
                    none.cast("string").alias("reasoning_content"), none.cast(f"array<{_CALL}>").alias("tool_calls"))
    answer = F.struct(F.lit("assistant").alias("role"), F.array(part("text", F.lit("done"))).alias("content"),
                      F.lit("weighs it").alias("reasoning_content"), F.array(call).alias("tool_calls"))
    return docs.select(
        F.when(shape == 0, F.array(user, answer)).alias("messages"),
        F.when(shape == 1, F.col("n_chars")).alias("prompt"), F.when(shape == 1, F.col("n_chars") > 1000).alias("completion"),
        F.when(shape == 2, F.col("source")).alias("instruction"), F.when(shape == 2, F.col("n_chars") / 2).alias("output"),
        F.when(shape == 3, F.col("text")).alias("body"))


_CALL = "struct<function:struct<name:string,arguments:struct<id:bigint,deep:boolean>>>"


def turns_with_responses(turns: DataFrame) -> DataFrame:
    """Each user turn after the first becomes a wrapped tool response."""
    wrapped = F.concat(F.lit("<tool_response>\n"), F.col("text"), F.lit("\n</tool_response>"))
    late = (F.col("role") == "user") & (F.col("turn") > 2)
    return turns.withColumn("text", F.when(late, wrapped).otherwise(F.col("text")))


def turns_with_tools(turns: DataFrame) -> DataFrame:
    """After each assistant turn come two tool turns with its text; ``turn`` is spaced out."""
    result = F.concat(F.lit(" result "), F.col("text"), F.lit("\n"))
    own = F.struct(F.lit(0).alias("k"), F.col("role").alias("role"), F.col("text").alias("text"))
    tools = [F.struct(F.lit(k).alias("k"), F.lit("tool").alias("role"), result.alias("text"))
             for k in (1, 2)]
    rows = F.when(F.col("role") == "assistant", F.array(own, *tools)).otherwise(F.array(own))
    return turns.select("conv_id", "turn", F.explode(rows).alias("v")).select(
        "conv_id", (F.col("turn") * 3 + F.col("v.k")).alias("turn"), "v.role", "v.text")


def call_message() -> Column:
    """Assistant turns call two tools whose arguments hold every kind of JSON value."""
    text = F.to_json(F.struct(F.col("text").alias("query")))
    many = F.concat(
        F.substring(text, F.lit(1), F.length(text) - 1), F.lit(',"turn":'), F.col("turn").cast("string"),
        F.lit(',"flag":true,"off":false,"none":null,"ratio":1.50,"deep":{"b":[1,2],"a":"é"}}'))
    calls = F.array(
        F.struct(F.lit("search").alias("name"), many.alias("arguments")),
        F.struct(F.lit("stop").alias("name"), F.lit("{}").alias("arguments")),
    )
    is_call = F.col("role") == "assistant"
    silent = is_call & (F.pmod("turn", F.lit(4)) == 1)
    return message(
        F.col("role"), F.when(silent, F.lit("")).otherwise(F.col("text")),
        tool_calls=F.when(is_call, calls),
    )


def media_message() -> Column:
    """User turns carry their text between a picture, a video and a second picture."""
    names = ("type", "text", "image", "image_url", "video")

    def part(**given):
        return F.struct(*[F.coalesce(given.get(n, F.lit(None).cast("string"))).alias(n) for n in names])

    parts = F.array(part(type=F.lit("image")), part(text=F.col("text"), type=F.lit("text")),
                    part(video=F.lit("clip")), part(image_url=F.lit("link")))
    is_user = F.col("role") == "user"
    return message(F.col("role"), F.when(~is_user, F.col("text")), parts=F.when(is_user, parts))


def thinking_variants(turns: DataFrame) -> DataFrame:
    """Assistant-style texts with and without think tags, for every turn."""
    t = F.col("text")
    kinds = {
        "plain": t,
        "tagged": F.concat(F.lit("<think>\n"), t, F.lit("\n</think>\n\n"), t),
        "unopened": F.concat(t, F.lit("\n\n</think>\nanswer")),
        "twice": F.concat(F.lit("<think>a<think>\n"), t, F.lit("</think>b</think>\n"), t),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("text")) for k, v in kinds.items()])
    return turns.select("conv_id", "turn", F.explode(rows).alias("v")).select("conv_id", "turn", "v.*")


def broken_conversations(grouped: DataFrame) -> DataFrame:
    """Every conversation as is and in each invalid form."""
    m = F.col("messages")
    names = ("type", "text", "image", "image_url", "video")

    def parts(**given):
        return F.array(F.struct(*[F.lit(given.get(n)).cast("string").alias(n) for n in names]))

    def lead(first):
        return F.concat(F.array(first), m)

    system, user = F.lit("system"), F.lit("user")
    forms = {
        "valid": m,
        "no_messages": F.slice(m, F.lit(1), F.lit(0)),
        "no_user": F.filter(m, lambda x: x["role"] != "user"),
        "late_system": F.concat(m, F.array(message(system, F.lit("late")))),
        "bad_role": F.concat(m, F.array(message(F.lit("critic"), F.lit("no")))),
        "system_image": lead(message(system, parts=parts(type="image"))),
        "system_video": lead(message(system, parts=parts(video="clip"))),
        "bad_part": F.concat(m, F.array(message(user, parts=parts(type="audio")))),
        "bad_content": F.concat(m, F.array(message(user, bad_content=F.lit(True)))),
        "bad_arguments": F.concat(m, F.array(message(F.lit("assistant"), F.lit(""), tool_calls=F.array(
            F.struct(F.lit("f").alias("name"), F.lit("[1]").alias("arguments")))))),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("messages")) for k, v in forms.items()])
    return grouped.select("conv_id", F.explode(rows).alias("v")).select("conv_id", "v.*")


def tool_list() -> Column:
    """One tool per conversation, as compact JSON with a non-ASCII description."""
    return F.concat(
        F.lit('[{"type":"function","function":{"name":"f_'), F.col("conv_id").cast("string"),
        F.lit('","description":"Étude \\"x\\"","parameters":{"required":["b","a"],"depth":1.0}}}]'))
