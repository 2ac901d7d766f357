"""Prompt text of a conversation, as expressions over its ``array<message>``.

The whole conversation is one array, so rendering is narrow: no shuffle once turns are grouped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.arrays import let
from tokenloom.functions.text import is_nonblank, strip
from tokenloom.schemas import CONTENT_PART

PARTS = f"array<{CONTENT_PART.simpleString()}>"

# The pieces of the prompt format.
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>\n"
IMAGE = "<|vision_start|><|image_pad|><|vision_end|>"
VIDEO = "<|vision_start|><|video_pad|><|vision_end|>"
TOOLS_INTRO = "# Tools\n\nYou have access to the following functions:\n\n<tools>"
TOOLS_RULES = (
    "\n</tools>"
    "\n\nIf you choose to call a function ONLY reply in the following format with NO suffix:\n\n"
    "<tool_call>\n<function=example_function_name>\n"
    "<parameter=example_parameter_1>\nvalue_1\n</parameter>\n"
    "<parameter=example_parameter_2>\n"
    "This is the value for the second parameter\nthat can span\nmultiple lines\n"
    "</parameter>\n</function>\n</tool_call>\n\n"
    "<IMPORTANT>\nReminder:\n"
    "- Function calls MUST follow the specified format: "
    "an inner <function=...></function> block must be nested within "
    "<tool_call></tool_call> XML tags\n"
    "- Required parameters MUST be specified\n"
    "- You may provide optional reasoning for your function call in natural language "
    "BEFORE the function call, but NOT after\n"
    "- If there is no function call available, answer the question like normal with your "
    "current knowledge and do not tell the user about function calls\n"
    "</IMPORTANT>"
)
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"
RESPONSE_OPEN = "<tool_response>"
RESPONSE_CLOSE = "</tool_response>"

# The messages of the format's error conditions.
NO_MESSAGES = "No messages provided."
NO_QUERY = "No user query found in messages."
SYSTEM_NOT_FIRST = "System message must be at the beginning."
BAD_ROLE = "Unexpected message role."
SYSTEM_IMAGE = "System message cannot contain images."
SYSTEM_VIDEO = "System message cannot contain videos."
BAD_PART = "Unexpected item type in content."
BAD_CONTENT = "Unexpected content type."
# Ours: arguments that are not a JSON object cannot be listed by name.
BAD_ARGUMENTS = "Tool call arguments must be an object."
UNNAMED_CALL = "Tool call has no name."

ROLES = ["system", "user", "assistant", "tool"]


@dataclass(frozen=True)
class PromptOptions:
    add_generation_prompt: bool = False
    enable_thinking: bool = False
    add_vision_id: bool = False
    ensure_ascii: bool = True


# --- content -----------------------------------------------------------------------------


def is_image(p: Column) -> Column:
    named = p["image"].isNotNull() | p["image_url"].isNotNull()
    return named | F.coalesce(p["type"] == "image", F.lit(False))


def is_video(p: Column) -> Column:
    video = p["video"].isNotNull() | F.coalesce(p["type"] == "video", F.lit(False))
    return ~is_image(p) & video


def is_unknown_part(p: Column) -> Column:
    return ~is_image(p) & ~is_video(p) & p["text"].isNull()


def content_text(m: Column) -> Column:
    """Text as is, parts concatenated, nothing as empty."""
    def one(p: Column) -> Column:
        return F.when(is_image(p), IMAGE).when(is_video(p), VIDEO).otherwise(F.coalesce(p["text"], F.lit("")))

    joined = F.array_join(F.transform(m["parts"], one), "")
    return F.coalesce(m["content"], joined, F.lit(""))


def media_counts(m: Column) -> tuple[Column, Column]:
    """Pictures and videos among the parts of a message; also those of one whose text is used instead."""
    parts = F.coalesce(m["parts"], F.array().cast(PARTS))
    return F.size(F.filter(parts, is_image)), F.size(F.filter(parts, is_video))


def numbered_text(m: Column, images: Column, videos: Column) -> Column:
    """Text of one message whose pictures and videos are numbered on from those before it."""
    def with_part(acc: Column, p: Column) -> Column:
        image = acc["images"] + F.when(is_image(p), 1).otherwise(0)
        video = acc["videos"] + F.when(is_video(p), 1).otherwise(0)
        shown = F.when(is_image(p), F.concat(F.lit("Picture "), image.cast("string"), F.lit(": " + IMAGE))) \
            .when(is_video(p), F.concat(F.lit("Video "), video.cast("string"), F.lit(": " + VIDEO))) \
            .otherwise(F.coalesce(p["text"], F.lit("")))
        return F.struct(image.alias("images"), video.alias("videos"), F.concat(acc["text"], shown).alias("text"))

    parts = F.coalesce(m["parts"], F.array().cast(PARTS))
    start = F.struct(images.cast("int").alias("images"), videos.cast("int").alias("videos"), F.lit("").alias("text"))
    return F.coalesce(m["content"], F.aggregate(parts, start, with_part, lambda acc: acc["text"]))


def numbered_texts(messages: Column) -> Column:
    """Texts of all messages with pictures and videos numbered through the conversation.

    A first pass carries the counts alone, so no text is copied more than once.
    """
    def counted(acc: Column, m: Column) -> Column:
        images, videos = media_counts(m)
        return F.struct((acc["images"] + images).alias("images"), (acc["videos"] + videos).alias("videos"),
                        F.concat(acc["ahead"], F.array(F.struct(acc["images"].alias("images"), acc["videos"].alias("videos")))).alias("ahead"))

    none = F.struct(F.lit(0).alias("images"), F.lit(0).alias("videos"), F.array().cast("array<struct<images:int,videos:int>>").alias("ahead"))
    ahead = F.aggregate(messages, none, counted, lambda acc: acc["ahead"])
    return F.zip_with(messages, ahead, lambda m, n: numbered_text(m, n["images"], n["videos"]))


# --- reasoning ---------------------------------------------------------------------------


def split_thinking(text: Column, explicit: Column) -> tuple[Column, Column]:
    """(reasoning, answer): an explicit reasoning wins, else think tags in the text are cut."""
    tagged = explicit.isNull() & F.contains(text, F.lit(THINK_CLOSE))
    ahead = F.rtrim(F.split_part(text, F.lit(THINK_CLOSE), F.lit(1)), F.lit("\n"))
    inner = F.ltrim(F.split_part(ahead, F.lit(THINK_OPEN), F.lit(-1)), F.lit("\n"))
    after = F.ltrim(F.split_part(text, F.lit(THINK_CLOSE), F.lit(-1)), F.lit("\n"))
    reasoning = F.when(explicit.isNotNull(), explicit).when(tagged, inner).otherwise(F.lit(""))
    return strip(reasoning), F.when(tagged, after).otherwise(text)


# --- turns -------------------------------------------------------------------------------


def is_query(role: Column, text: Column) -> Column:
    """A user turn that is not a wrapped tool response; ``text`` is already stripped."""
    wrapped = text.startswith(RESPONSE_OPEN) & text.endswith(RESPONSE_CLOSE)
    return (role == "user") & ~wrapped


def last_query(turns: Column) -> Column:
    """Index of the last real user query among normalized turns; null if there is none."""
    return F.array_max(F.transform(turns, lambda t, i: F.when(is_query(t["role"], t["text"]), i)))


def normalize_turns(messages: Column, options: PromptOptions, arguments: Column | None) -> Column:
    """Turns as ``struct<role, text, calls>``: stripped text and per-call (name, parameter text)."""
    def turn(m: Column, i: Column, texts: Column | None = None) -> Column:
        text = content_text(m) if texts is None else F.get(texts, i)
        fields = [m["role"].alias("role"), strip(text).alias("text"),
                  m["reasoning_content"].alias("reasoning")]
        if arguments is not None:
            fields.append(F.zip_with(
                m["tool_calls"], F.get(arguments, i),
                lambda c, block: F.struct(c["name"].alias("name"), block.alias("block")),
            ).alias("calls"))
        return F.struct(*fields)

    if options.add_vision_id:
        return let(numbered_texts(messages), lambda texts: F.transform(messages, lambda m, i: turn(m, i, texts)))
    return F.transform(messages, lambda m, i: turn(m, i))


def tool_call_text(calls: Column, text: Column) -> Column:
    """All calls of one assistant turn, the separator depending on position and on the text."""
    lead = F.when(is_nonblank(text), F.lit("\n\n")).otherwise(F.lit(""))
    one = lambda c, k: F.concat(
        F.when(k == 0, lead).otherwise(F.lit("\n")),
        F.lit("<tool_call>\n<function="), c["name"], F.lit(">\n"), c["block"],
        F.lit("</function>\n</tool_call>"))
    return F.coalesce(F.array_join(F.transform(calls, one), ""), F.lit(""))


def _turn_text(turns: Column, t: Column, i: Column, query: Column, with_calls: bool) -> Column:
    role_at = lambda k: F.get(turns, k)["role"]
    return turn_text(t, i > query, i > 0, role_at(i - 1), role_at(i + 1), with_calls)


def turn_text(t: Column, after_query: Column, follows: Column, before: Column, after: Column, with_calls: bool) -> Column:
    """Text of one normalized turn, given whether it comes after the last query, whether a turn stands
    ahead of it, and the roles of its neighbours (null for none)."""
    def assistant(split: Column) -> Column:
        think = F.concat(F.lit("<think>\n"), split["reasoning"], F.lit("\n</think>\n\n"))
        calls = tool_call_text(t["calls"], split["answer"]) if with_calls else F.lit("")
        return F.concat(F.lit(TURN_START + "assistant\n"),
                        F.when(after_query, think).otherwise(F.lit("")),
                        split["answer"], calls, F.lit(TURN_END))

    reasoning, answer = split_thinking(t["text"], t["reasoning"])
    split = F.struct(reasoning.alias("reasoning"), answer.alias("answer"))
    opens = follows & ~F.coalesce(before == "tool", F.lit(False))
    closes = ~F.coalesce(after == "tool", F.lit(False))
    tool = F.concat(F.when(opens, F.lit(TURN_START + "user")).otherwise(F.lit("")),
                    F.lit(f"\n{RESPONSE_OPEN}\n"), t["text"], F.lit(f"\n{RESPONSE_CLOSE}"),
                    F.when(closes, F.lit(TURN_END)).otherwise(F.lit("")))
    return (
        F.when(t["role"] == "user", F.concat(F.lit(TURN_START + "user\n"), t["text"], F.lit(TURN_END)))
        .when(t["role"] == "assistant", let(split, assistant))
        .when(t["role"] == "tool", tool)
        .otherwise(F.lit(""))
    )


def system_text(first: Column, tool_lines: Column | None) -> Column:
    """Opening system block: the tool list when there are tools, else the system turn if any."""
    is_system = F.coalesce(first["role"] == "system", F.lit(False))
    plain = F.when(is_system, F.concat(F.lit(TURN_START + "system\n"), first["text"], F.lit(TURN_END))) \
        .otherwise(F.lit(""))
    if tool_lines is None:
        return plain
    listed = F.array_join(F.transform(tool_lines, lambda t: F.concat(F.lit("\n"), t)), "")
    extra = F.when(is_system & (F.length(first["text"]) > 0), F.concat(F.lit("\n\n"), first["text"])) \
        .otherwise(F.lit(""))
    full = F.concat(F.lit(TURN_START + "system\n" + TOOLS_INTRO), listed, F.lit(TOOLS_RULES),
                    extra, F.lit(TURN_END))
    return F.when(F.size(F.coalesce(tool_lines, F.array().cast("array<string>"))) > 0, full).otherwise(plain)


def generation_prompt(options: PromptOptions) -> str:
    if not options.add_generation_prompt:
        return ""
    think = "<think>\n" if options.enable_thinking else "<think>\n\n</think>\n\n"
    return TURN_START + "assistant\n" + think


def prompt_text(messages: Column, options: PromptOptions, tool_lines: Column | None = None,
                arguments: Column | None = None) -> Column:
    """The whole prompt. Meaningful for conversations that pass ``problems``."""
    def body(turns: Column) -> Column:
        def with_query(query: Column) -> Column:
            pieces = F.transform(turns, lambda t, i: _turn_text(turns, t, i, query, arguments is not None))
            return F.concat(system_text(F.get(turns, F.lit(0)), tool_lines),
                            F.array_join(pieces, ""), F.lit(generation_prompt(options)))
        return let(last_query(turns), with_query)

    return let(normalize_turns(messages, options, arguments), body)


def raw_arguments(messages: Column) -> Column:
    """JSON arguments of every assistant call, per message; null for other messages."""
    return F.transform(messages, lambda m: F.when(
        m["role"] == "assistant", F.transform(m["tool_calls"], lambda c: c["arguments"])))


# --- validation --------------------------------------------------------------------------


def problems(messages: Column, arguments: Column | None = None) -> Column:
    """Every reason the conversation cannot be rendered, each once; empty when it can."""
    def any_message(test) -> Column:
        return F.coalesce(F.exists(messages, test), F.lit(False))

    def any_part(test, role: str | None = None) -> Column:
        def has(m: Column) -> Column:
            found = F.coalesce(F.exists(m["parts"], test), F.lit(False)) & m["content"].isNull()
            return found if role is None else found & (m["role"] == role)
        return any_message(has)

    first = F.get(messages, F.lit(0))

    def first_has(test) -> Column:
        return F.coalesce((first["role"] == "system") & first["content"].isNull()
                          & F.exists(first["parts"], test), F.lit(False))

    filled = F.coalesce(F.size(messages) > 0, F.lit(False))
    queries = any_message(lambda m: is_query(m["role"], strip(content_text(m))))
    late_system = F.coalesce(F.exists(
        F.slice(messages, F.lit(2), F.greatest(F.size(messages), F.lit(1))),
        lambda m: m["role"] == "system"), F.lit(False))
    bad_role = any_message(lambda m: ~F.coalesce(m["role"].isin(ROLES), F.lit(False)))
    bad_content = any_message(lambda m: F.coalesce(m["bad_content"], F.lit(False)))
    checks = [
        (~filled, NO_MESSAGES),
        (first_has(is_image), SYSTEM_IMAGE),
        (first_has(is_video), SYSTEM_VIDEO),
        (any_part(is_unknown_part), BAD_PART),
        (bad_content, BAD_CONTENT),
        (filled & ~queries, NO_QUERY),
        (late_system, SYSTEM_NOT_FIRST),
        (bad_role, BAD_ROLE),
    ]
    if arguments is not None:
        unreadable = F.exists(arguments, lambda calls: F.exists(calls, lambda block: block.isNull()))
        unnamed = any_message(lambda m: (m["role"] == "assistant")
                              & F.exists(m["tool_calls"], lambda c: c["name"].isNull()))
        checks += [(F.coalesce(unreadable, F.lit(False)), BAD_ARGUMENTS), (unnamed, UNNAMED_CALL)]
    return F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in checks]))
