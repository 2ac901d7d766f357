"""Conversations to prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.chat import (
    PromptOptions,
    content_text,
    is_query,
    numbered_texts,
    problems,
    prompt_text,
    raw_arguments,
    split_thinking,
)
from tokenloom.functions.text import argument_blocks, json_equal, json_items, strip
from tokenloom.operators.indexing import join_on
from tokenloom.schemas import MESSAGE

_FIELDS = {f.name: f.dataType.simpleString() for f in MESSAGE}


def message(role: Column, content: Column | None = None, **fields: Column) -> Column:
    """A message struct; fields not given are null."""
    given = {"role": role, "content": content, **fields}
    return F.struct(*[
        (given[name] if given.get(name) is not None else F.lit(None)).cast(kind).alias(name)
        for name, kind in _FIELDS.items()
    ])


def group_turns(turns: DataFrame, conversation: str, turn: str,
                messages: Column | None = None) -> DataFrame:
    """Turn rows to one row per conversation with ``messages`` in turn order: one shuffle."""
    one = message(F.col("role"), F.col("text")) if messages is None else messages
    return (
        turns.repartition(conversation).groupBy(conversation)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("at"), one.alias("m"))))
             .alias("_turns"))
        .select(conversation, F.col("_turns.m").alias("messages"))
    )


def render(df: DataFrame, options: PromptOptions | None = None, messages: str = "messages",
           tools: str | None = None, strict: bool = False, tool_calls: bool = True) -> DataFrame:
    """Add ``prompt`` and ``errors`` to rows with a message array.

    Rows that cannot be rendered have a null prompt and their reasons in ``errors``; ``strict``
    fails the job on the first of them. ``tools`` names a column of raw JSON lists. Python runs
    only to spell JSON, for tools and call arguments; ``tool_calls=False`` leaves calls out.
    """
    options = options or PromptOptions()
    source = F.col(messages)
    tool_lines = arguments = None
    if tools is not None:
        df = df.withColumn("_tool_lines", json_items(F.col(tools), options.ensure_ascii))
        tool_lines = F.col("_tool_lines")
    if tool_calls:
        df = df.withColumn("_arguments", argument_blocks(raw_arguments(source), options.ensure_ascii))
        arguments = F.col("_arguments")
    df = df.withColumn("errors", problems(source, arguments))
    text = F.when(F.size("errors") == 0, prompt_text(source, options, tool_lines, arguments))
    if strict:
        text = text.otherwise(F.raise_error(F.get("errors", F.lit(0))).cast("string"))
    return df.withColumn("prompt", text).drop("_tool_lines", "_arguments")


def validate(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Add ``errors ARRAY<STRING>``."""
    return (
        df.withColumn("_arguments", argument_blocks(raw_arguments(F.col(messages))))
        .withColumn("errors", problems(F.col(messages), F.col("_arguments")))
        .drop("_arguments")
    )


def normalize_content(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Add ``contents``: the plain text of every message."""
    return df.withColumn("contents", F.transform(messages, lambda m: content_text(m)))


def number_media(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Add ``contents`` with pictures and videos numbered through the conversation."""
    return df.withColumn("contents", numbered_texts(F.col(messages)))


def thinking(df: DataFrame, text: str = "text", explicit: str | None = None) -> DataFrame:
    """Add ``reasoning`` and ``answer`` from an assistant text."""
    given = F.lit(None).cast("string") if explicit is None else F.col(explicit)
    reasoning, answer = split_thinking(strip(F.col(text)), given)
    return df.withColumn("reasoning", reasoning).withColumn("answer", answer)


def last_query_turn(turns: DataFrame, conversation: str, turn: str, role: str = "role",
                    text: str = "text") -> DataFrame:
    """Turn of the last real user query per conversation; null where there is none.

    A plain aggregate, so turns combine before the shuffle.
    """
    query = is_query(F.col(role), strip(F.coalesce(text, F.lit(""))))
    return turns.groupBy(conversation).agg(F.max(F.when(query, F.col(turn))).alias("last_query"))


def check_expectations(samples: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """Judge ``answers(id, answer, tool_name, tool_args)`` against ``samples.expected``.

    Samples without an answer get a row too and fail what they expect; null ids meet each other.
    Absent expectations pass. ``answer`` must hold every listed phrase and keep to the length
    bounds; a tool call must match in name and, by JSON value, in arguments.
    """
    joined = join_on(samples.select(key, "expected"), answers, [key], "left")
    want = F.col("expected")
    length = F.char_length("answer")

    def absent_or(expected: Column, holds: Column) -> Column:
        return expected.isNull() | F.coalesce(holds, F.lit(False))

    answer = F.col("answer")
    phrases = F.forall(want["must_include"], lambda p: F.contains(answer, p))
    call = want["tool_call"]
    same_args = json_equal(call["args"], F.col("tool_args"))
    return (
        joined.withColumn("_same_args", same_args)
        .select(
            key,
            absent_or(want["must_include"], phrases).alias("includes_all"),
            (absent_or(want["min_chars"], length >= want["min_chars"])
             & absent_or(want["max_chars"], length <= want["max_chars"])).alias("length_ok"),
            (absent_or(call, call["name"] == F.col("tool_name"))
             & absent_or(call["args"], F.col("_same_args"))).alias("tool_ok"),
        )
        .withColumn("passed", F.col("includes_all") & F.col("length_ok") & F.col("tool_ok"))
    )
