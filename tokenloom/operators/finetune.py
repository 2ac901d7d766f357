"""Fine-tuning rows to prompt strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.chat import PromptOptions
from tokenloom.operators.chat import message, render
from tokenloom.operators.encode import Encoder, truncate
from tokenloom.schemas import MESSAGE

NO_SHAPE = "The row holds no messages, prompt+completion, instruction+output or {}."


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def row_messages(df: DataFrame) -> Column:
    """Messages of a row: given ones, prompt/completion, or instruction(/input)/output; else null."""
    pair = lambda user, answer: F.array(
        message(F.lit("user"), user), message(F.lit("assistant"), answer))
    prompt, completion = _column(df, "prompt"), _column(df, "completion")
    instruction, output, extra = (_column(df, c) for c in ("instruction", "output", "input"))
    asked = F.when(F.length(extra) > 0, F.concat(instruction, F.lit("\n"), extra)) \
        .otherwise(instruction)
    branches = F.when(prompt.isNotNull() & completion.isNotNull(), pair(prompt, completion)) \
        .when(instruction.isNotNull() & output.isNotNull(), pair(asked, output))
    if "messages" not in df.columns:
        return branches
    given = _as_messages(df)
    return F.when(F.size(given) > 0, given).otherwise(branches)


def _as_messages(df: DataFrame) -> Column:
    """Message structs with the full field set, whichever fields the source declares."""
    declared = df.schema["messages"].dataType.elementType.fieldNames()
    optional = [n for n in MESSAGE.fieldNames() if n in declared and n not in ("role", "content")]
    return F.transform("messages", lambda m: message(
        m["role"], m["content"], **{n: m[n] for n in optional}))


def format_rows(df: DataFrame, text_column: str = "text", with_tools: bool = False,
                strict: bool = False) -> DataFrame:
    """Add ``prompt`` and ``errors``; the first matching row shape wins, raw text comes last.

    ``with_tools`` also renders a ``tools`` column, otherwise it is ignored.
    """
    options = PromptOptions(ensure_ascii=False)
    has_calls = "messages" in df.columns and \
        "tool_calls" in df.schema["messages"].dataType.elementType.fieldNames()
    shaped = df.withColumn("_messages", row_messages(df))
    rendered = render(shaped, options, "_messages", "tools" if with_tools else None,
                      tool_calls=has_calls)
    raw = _column(df, text_column)
    plain = F.col("_messages").isNull()
    missing = F.lit(NO_SHAPE.format(text_column))
    errors = F.when(~plain, F.col("errors")) \
        .when(raw.isNull(), F.array(missing)).otherwise(F.array().cast("array<string>"))
    prompt = F.when(plain, raw).otherwise(F.col("prompt"))
    out = rendered.withColumn("prompt", prompt).withColumn("errors", errors).drop("_messages")
    if strict:
        failed = F.raise_error(F.get("errors", F.lit(0))).cast("string")
        out = out.withColumn("prompt", F.when(F.size("errors") == 0, F.col("prompt")).otherwise(failed))
    return out


def tokenize_prompts(df: DataFrame, encoder: Encoder, max_len: int) -> DataFrame:
    """Encode ``prompt`` and cut it to ``max_len`` tokens."""
    return truncate(encoder.encode(df, "prompt"), max_len)
