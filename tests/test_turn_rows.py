"""Row-form rendering gives the prompts of the array form, also where conversations cross partitions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.chat import PromptOptions
from tokenloom.operators import chat, turn_rows
from tokenloom.operators.chat import message
from tokenloom.operators.indexing import join_on

PARTS = "array<struct<type:string,text:string,image:string,image_url:string,video:string>>"
SCHEMA = f"conv long, turn long, role string, text string, parts {PARTS}, reasoning string, calls array<struct<name:string,arguments:string>>, bad boolean, tools string"


def part(kind=None, text=None, image=None, video=None):
    return (kind, text, image, None, video)


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(3)
    rows = []

    def add(conv, turn, role, text="", parts=None, reasoning=None, calls=None, bad=None):
        tools = '[{"name": "f", "x": [1, "é"]}]' if conv is not None and conv % 5 == 0 else None
        rows.append((conv, turn, role, text, parts, reasoning, calls, bad, tools))

    for conv, size in [(0, 300), (None, 7), *[(c, rng.randint(1, 9)) for c in range(1, 40)]]:
        for turn in range(size):
            role = "system" if turn == 0 and rng.random() < 0.3 else rng.choice(["user", "assistant", "tool", "tool"])
            media = rng.random() < 0.3 and role == "user"
            parts = [part("image"), part("text", f"see {turn}"), part(video="v")][: rng.randint(1, 3)] if media else None
            calls = [("f", '{"a": 1, "b": {"c": [true]}}'), ("g", "{}")] if role == "assistant" and rng.random() < 0.4 else None
            text = rng.choice([" plain \n", "<think>a</think>\n b", "<tool_response>\nx\n</tool_response>", ""])
            add(conv, turn, role, None if media else text, parts, "why" if rng.random() < 0.1 else None, calls)
        add(conv, size, "user", "asks")
    add(50, 0, "system", None, [part("image"), part(video="v")])
    add(50, 1, "user", "x")
    add(51, 0, "user", "x")
    add(51, 1, "system", "late")
    add(52, 0, "assistant", "no query")
    add(53, 0, "user", None, [part("audio")])
    add(54, 0, "critic", "x", bad=True)
    add(54, 1, "user", "x")
    add(55, 0, "assistant", "x", calls=[(None, "[1]")])
    add(55, 1, "user", "x")
    add(56, 0, None, "x")
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def as_message():
    return message(F.col("role"), F.col("text"), parts=F.col("parts"), reasoning_content=F.col("reasoning"), tool_calls=F.col("calls"), bad_content=F.col("bad"))


@pytest.mark.parametrize("options, tools, calls", [
    (PromptOptions(), None, False),
    (PromptOptions(add_vision_id=True, add_generation_prompt=True), "tools", True),
])
def test_pieces_make_the_prompt(spark, turns, options, tools, calls):
    grouped = chat.group_turns(turns, "conv", "turn", as_message())
    if tools:
        grouped = join_on(grouped, turns.groupBy("conv").agg(F.max("tools").alias("tools")), ["conv"])
    expected = {r.conv: (r.prompt, r.errors) for r in chat.render(grouped, options, tools=tools, tool_calls=calls).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        placed = turn_rows.placed_turns(turns, "conv", "turn", as_message(), options, tools, calls)
        assert placed.where("conv = 0").select("part").distinct().count() >= 6  # the large conversation is spread
        rows = turn_rows.render_turns(turns, "conv", "turn", as_message(), options, tools, calls).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == turns.count()
    found = {}
    for r in sorted(rows, key=lambda r: r.turn):
        text, errors = found.get(r.conv, ("", r.errors))
        assert errors == r.errors
        found[r.conv] = (text + r.piece if r.piece is not None else None, errors)
    assert found == expected
    assert {tuple(e) for _, e in expected.values() if e}


def test_no_conversation_is_one_value(turns):
    plan = turn_rows.render_turns(turns, "conv", "turn", as_message())._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SinglePartition" not in plan and "Python" not in plan
