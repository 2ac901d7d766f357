"""Special tokens of the chat tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Content and whether the tokenizer marks the token as special, in id order.
FIRST_SPECIAL_ID = 248044
SPECIAL_TOKENS = [
    ("<|endoftext|>", True),
    ("<|im_start|>", True),
    ("<|im_end|>", True),
    ("<|object_ref_start|>", True),
    ("<|object_ref_end|>", True),
    ("<|box_start|>", True),
    ("<|box_end|>", True),
    ("<|quad_start|>", True),
    ("<|quad_end|>", True),
    ("<|vision_start|>", True),
    ("<|vision_end|>", True),
    ("<|vision_pad|>", True),
    ("<|image_pad|>", True),
    ("<|video_pad|>", True),
    ("<tool_call>", False),
    ("</tool_call>", False),
    ("<|fim_prefix|>", False),
    ("<|fim_middle|>", False),
    ("<|fim_suffix|>", False),
    ("<|fim_pad|>", False),
    ("<|repo_name|>", False),
    ("<|file_sep|>", False),
    ("<tool_response>", False),
    ("</tool_response>", False),
    ("<think>", False),
    ("</think>", False),
    ("<|audio_start|>", True),
    ("<|audio_end|>", True),
    ("<tts_pad>", True),
    ("<tts_text_bos>", True),
    ("<tts_text_eod>", True),
    ("<tts_text_bos_single>", True),
    ("<|audio_pad|>", True),
]

# Tokens listed as additional specials (ids 248045 to 248057).
ADDITIONAL = [content for content, _ in SPECIAL_TOKENS[1:14]]


def special_ids() -> dict[str, int]:
    return {content: FIRST_SPECIAL_ID + i for i, (content, _) in enumerate(SPECIAL_TOKENS)}


def special_tokens(spark: SparkSession) -> DataFrame:
    """The special-token dimension table, 33 rows."""
    rows = [
        (FIRST_SPECIAL_ID + i, content, False, False, False, False, special, content in ADDITIONAL)
        for i, (content, special) in enumerate(SPECIAL_TOKENS)
    ]
    return spark.createDataFrame(
        rows,
        "id int, content string, lstrip boolean, rstrip boolean, normalized boolean, "
        "single_word boolean, special boolean, additional boolean",
    )


def resolve_pad_id(pad_id: int | None, eos_id: int | None) -> int:
    """Padding falls back to the end id; neither known is an error."""
    chosen = pad_id if pad_id is not None else eos_id
    if chosen is None:
        raise ValueError("pad_id or eos_id is required")
    return chosen
