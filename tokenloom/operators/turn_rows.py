"""Conversations to prompts, a row for each turn: no conversation is ever one value.

Turns are range-sorted by (conversation, turn). What a turn needs of its neighbours comes from windows inside
its partition; what crosses partitions (the neighbours' roles, picture and video numbers, the last
query, errors) is carried by one summary row per conversation and partition. A conversation of any
size so stays spread over the partitions its turns are in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.functions import chat as C
from tokenloom.functions.text import argument_blocks, json_items, strip
from tokenloom.operators.chat import message
from tokenloom.staging import stage

# Errors a row shows on its own, by bit.
_ROW_ERRORS = [C.BAD_PART, C.BAD_CONTENT, C.BAD_ROLE, C.BAD_ARGUMENTS, C.UNNAMED_CALL]


def _has_part(m: Column, test) -> Column:
    return F.coalesce(F.exists(m["parts"], test), F.lit(False)) & m["content"].isNull()


def _row_errors(m: Column, arguments: Column | None) -> Column:
    checks = [_has_part(m, C.is_unknown_part), F.coalesce(m["bad_content"], F.lit(False)),
              ~F.coalesce(m["role"].isin(C.ROLES), F.lit(False))]
    if arguments is not None:
        unnamed = (m["role"] == "assistant") & F.exists(m["tool_calls"], lambda c: c["name"].isNull())
        checks += [F.exists(arguments, lambda block: block.isNull()), unnamed]
    bits = [F.when(F.coalesce(check, F.lit(False)), 1 << k).otherwise(0) for k, check in enumerate(checks)]
    return reduce(Column.__add__, bits)


def placed_turns(turns: DataFrame, conversation: str, turn: str, messages: Column | None = None,
                 options: C.PromptOptions | None = None, tools: str | None = None, tool_calls: bool = False) -> DataFrame:
    """Turns staged in order: conv, turn, m (message), part, place, and what is counted of each row.

    Turns of a conversation should differ; rows of equal turn go by role and content.
    """
    options = options or C.PromptOptions()
    one = message(F.col("role"), F.col("text")) if messages is None else messages
    rows = turns.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), one.alias("m"),
                        (F.lit(None).cast("string") if tools is None else F.col(tools)).alias("tools"))
    m, arguments = F.col("m"), None
    if tool_calls:
        calls = F.when(m["role"] == "assistant", F.transform(m["tool_calls"], lambda c: c["arguments"]))
        rows = rows.withColumn("arguments", F.get(argument_blocks(F.array(calls), options.ensure_ascii), F.lit(0)))
        arguments = F.col("arguments")
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), m["role"], F.xxhash64(m["content"])]
    images, videos = C.media_counts(m)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ranged.select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"),
        images.alias("images"), videos.alias("videos"),
        C.is_query(m["role"], strip(C.content_text(m))).alias("asks"), _row_errors(m, arguments).alias("bits"),
        _has_part(m, C.is_image).alias("shows"), _has_part(m, C.is_video).alias("plays")), "turns")


def _carried(placed: DataFrame) -> DataFrame:
    """Per conversation and partition: what stands before and after it, and what holds for the whole conversation."""
    role, place = F.col("m.role"), F.col("place")
    system = F.coalesce(role == "system", F.lit(False))
    parts = placed.select("conv", "part", "place", "m.role", "images", "videos", "asks", "bits", "shows", "plays").withColumn("m", F.struct("role")).groupBy("conv", "part").agg(
        F.min_by(F.struct(role.alias("role"), "shows", "plays"), place).alias("head"), F.max_by(role, place).alias("tail"),
        F.sum("images").alias("images"), F.sum("videos").alias("videos"),
        F.max(F.when(F.col("asks"), place)).alias("query"), F.bit_or("bits").alias("bits"), F.sum(system.cast("int")).alias("systems"))
    order, whole = W.partitionBy("conv").orderBy("part"), W.partitionBy("conv")
    ahead = order.rowsBetween(W.unboundedPreceding, -1)
    entire = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = F.first("head").over(entire)
    opens = F.coalesce(first["role"] == "system", F.lit(False))
    bits, query = F.bit_or("bits").over(whole), F.max("query").over(whole)
    late = F.sum("systems").over(whole) > opens.cast("int")
    on = lambda text: (bits.bitwiseAND(1 << _ROW_ERRORS.index(text))) > 0
    checks = [(opens & first["shows"], C.SYSTEM_IMAGE), (opens & first["plays"], C.SYSTEM_VIDEO), (on(C.BAD_PART), C.BAD_PART),
              (on(C.BAD_CONTENT), C.BAD_CONTENT), (query.isNull(), C.NO_QUERY), (late, C.SYSTEM_NOT_FIRST), (on(C.BAD_ROLE), C.BAD_ROLE),
              (on(C.BAD_ARGUMENTS), C.BAD_ARGUMENTS), (on(C.UNNAMED_CALL), C.UNNAMED_CALL)]
    return parts.select(
        F.col("conv").alias("_conv"), F.col("part").alias("_part"),
        F.lag("part").over(order).isNotNull().alias("has_before"), F.lag("tail").over(order).alias("role_before"),
        F.lead("part").over(order).isNotNull().alias("has_after"), F.lead("head").over(order)["role"].alias("role_after"),
        F.coalesce(F.sum("images").over(ahead), F.lit(0)).alias("images_before"),
        F.coalesce(F.sum("videos").over(ahead), F.lit(0)).alias("videos_before"), query.alias("query"),
        F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks])).alias("errors"))


def turn_facts(placed: DataFrame) -> DataFrame:
    """``placed_turns`` with each row's neighbours and running numbers:

    first, last (of its conversation), before, after (roles of its neighbours), images_before, videos_before
    (in earlier turns), query (place of the last real user query) and errors (of the conversation).
    """
    carried = _carried(placed)
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    rows = placed.join(carried, same).drop("_conv", "_part")
    inside = W.partitionBy("part", "conv").orderBy("place")
    ahead = inside.rowsBetween(W.unboundedPreceding, -1)
    follows, leads = F.lag("place").over(inside).isNotNull(), F.lead("place").over(inside).isNotNull()
    role = F.col("m.role")
    return rows.select(
        "conv", "turn", "m", "tools", "place", *(["arguments"] if "arguments" in rows.columns else []), "query", "errors",
        (~follows & ~F.col("has_before")).alias("first"), (~leads & ~F.col("has_after")).alias("last"),
        F.when(follows, F.lag(role).over(inside)).otherwise(F.col("role_before")).alias("before"),
        F.when(leads, F.lead(role).over(inside)).otherwise(F.col("role_after")).alias("after"),
        (F.col("images_before") + F.coalesce(F.sum("images").over(ahead), F.lit(0))).alias("images_before"),
        (F.col("videos_before") + F.coalesce(F.sum("videos").over(ahead), F.lit(0))).alias("videos_before"))


def render_turns(turns: DataFrame, conversation: str, turn: str, messages: Column | None = None,
                 options: C.PromptOptions | None = None, tools: str | None = None, tool_calls: bool = False) -> DataFrame:
    """``conversation``, ``turn``, ``piece``, ``errors``: each turn's part of its conversation's prompt.

    Pieces of a conversation, joined in the order of turns, are the prompt that ``render`` gives; the opening
    system block is part of the first piece, a generation prompt of the last. Where the
    conversation cannot be rendered, pieces are null and ``errors`` says why. ``tools`` names a column of raw
    JSON lists, read in the first turn. Python runs only to spell JSON.
    """
    options = options or C.PromptOptions()
    facts = turn_facts(placed_turns(turns, conversation, turn, messages, options, tools, tool_calls))
    m = F.col("m")
    text = C.numbered_text(m, F.col("images_before"), F.col("videos_before")) if options.add_vision_id else C.content_text(m)
    fields = [m["role"].alias("role"), strip(text).alias("text"), m["reasoning_content"].alias("reasoning")]
    if tool_calls:
        fields.append(F.zip_with(m["tool_calls"], F.col("arguments"), lambda c, b: F.struct(c["name"].alias("name"), b.alias("block"))).alias("calls"))
    facts = facts.withColumn("t", F.struct(*fields))
    tool_lines = None
    if tools is not None:
        facts = facts.withColumn("_lines", json_items(F.when(F.col("first"), F.col("tools")), options.ensure_ascii))
        tool_lines = F.col("_lines")
    t = F.col("t")
    body = C.turn_text(t, F.col("place") > F.col("query"), ~F.col("first"), F.col("before"), F.col("after"), tool_calls)
    piece = F.concat(F.when(F.col("first"), C.system_text(t, tool_lines)).otherwise(F.lit("")), body,
                     F.when(F.col("last"), F.lit(C.generation_prompt(options))).otherwise(F.lit("")))
    return facts.select(F.col("conv").alias(conversation), F.col("turn").alias(turn), F.when(F.size("errors") == 0, piece).alias("piece"), "errors")
