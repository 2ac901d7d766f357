"""Prompt rendering, one hand-derived string per rule."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tokenloom.functions.chat import PromptOptions
from tokenloom.operators.chat import group_turns, number_media, render, thinking, validate
from tokenloom.operators.finetune import format_rows
from tokenloom.schemas import MESSAGE

SCHEMA = f"id string, messages array<{MESSAGE.simpleString()}>, tools string"


def m(role, content=None, **more):
    return (role, content, more.get("parts"), more.get("reasoning"), more.get("calls"), more.get("bad"))


def part(**given):
    return tuple(given.get(k) for k in ("type", "text", "image", "image_url", "video"))


def prompts(spark, cases, options=None, **kwargs):
    rows = [(name, messages, tools) for name, (messages, tools) in cases.items()]
    return {r.id: r for r in render(spark.createDataFrame(rows, SCHEMA), options, **kwargs).collect()}


def user(text):
    return f"<|im_start|>user\n{text}<|im_end|>\n"


def test_roles_and_thinking(spark):
    ask = m("user", " q\u3000\n")
    cases = {
        "user": ([ask], None),
        "system": ([m("system", "\n s "), ask], None),
        "empty_system": ([m("system", None), ask], None),
        "final_answer": ([ask, m("assistant", "a")], None),
        "earlier_answer": ([ask, m("assistant", "<think>\nr\n</think>\n\na"), ask], None),
        "tagged": ([ask, m("assistant", "<think>\n r \n</think>\n\n\na")], None),
        "unopened": ([ask, m("assistant", "r\n</think>a")], None),
        "several": ([ask, m("assistant", "<think>x</think>y</think>\nz")], None),
        "reopened": ([ask, m("assistant", "<think>x<think>\ny</think>z")], None),
        "explicit": ([ask, m("assistant", "<think>x</think>y", reasoning=" r\n")], None),
        "explicit_empty": ([ask, m("assistant", "<think>x</think>y", reasoning="")], None),
        "response_is_no_query": ([ask, m("assistant", "a"), m("user", "<tool_response>x</tool_response>")], None),
        "open_response_is": ([ask, m("assistant", "a"), m("user", "<tool_response>x")], None),
    }
    out = {k: r.prompt for k, r in prompts(spark, cases).items()}
    q, start, end = user("q"), "<|im_start|>assistant\n", "<|im_end|>\n"
    assert out["user"] == q
    assert out["system"] == f"<|im_start|>system\ns{end}{q}"
    assert out["empty_system"] == f"<|im_start|>system\n{end}{q}"
    assert out["final_answer"] == f"{q}{start}<think>\n\n</think>\n\na{end}"
    assert out["earlier_answer"] == f"{q}{start}a{end}{q}"
    assert out["tagged"] == f"{q}{start}<think>\nr\n</think>\n\na{end}"
    assert out["unopened"] == f"{q}{start}<think>\nr\n</think>\n\na{end}"
    assert out["several"] == f"{q}{start}<think>\nx\n</think>\n\nz{end}"
    assert out["reopened"] == f"{q}{start}<think>\ny\n</think>\n\nz{end}"
    assert out["explicit"] == f"{q}{start}<think>\nr\n</think>\n\n<think>x</think>y{end}"
    assert out["explicit_empty"] == f"{q}{start}<think>\n\n</think>\n\n<think>x</think>y{end}"
    wrapped = user("<tool_response>x</tool_response>")
    assert out["response_is_no_query"] == f"{q}{start}<think>\n\n</think>\n\na{end}{wrapped}"
    assert out["open_response_is"] == f"{q}{start}a{end}{user('<tool_response>x')}"


def test_tool_calls(spark):
    ask = m("user", "q")
    args = '{"s": "x y", "t": true, "n": null, "i": 3, "f": 1e5, "l": [1, "é"], "o": {"b": 1, "a": 2}}'
    cases = {
        "silent": ([ask, m("assistant", "", calls=[("f", "{}")])], None),
        "spoken": ([ask, m("assistant", "hm", calls=[("f", None), ("g", '{"a": "1"}')])], None),
        "values": ([ask, m("assistant", None, calls=[("f", args)])], None),
        "blank_answer": ([ask, m("assistant", "r</think> \u3000", calls=[("f", "{}")])], None),
        "none": ([ask, m("assistant", "a", calls=[])], None),
        "broken": ([ask, m("assistant", "a", calls=[("f", "[1]")])], None),
        "unnamed": ([ask, m("assistant", "a", calls=[(None, "{}")])], None),
        "not_a_call": ([m("user", "q", calls=[("f", "[1]")])], None),
    }
    out = prompts(spark, cases)
    head = "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<think>\n{}\n</think>\n\n"
    empty = head.format("")
    call = "<tool_call>\n<function={}>\n{}</function>\n</tool_call>"
    end = "<|im_end|>\n"
    assert out["silent"].prompt == empty + call.format("f", "") + end
    assert out["spoken"].prompt == (empty + "hm\n\n" + call.format("f", "") + "\n"
                                    + call.format("g", "<parameter=a>\n1\n</parameter>\n") + end)
    shown = {"s": "x y", "t": "True", "n": "None", "i": "3", "f": "100000.0", "l": '[1, "\\u00e9"]',
             "o": '{"b": 1, "a": 2}'}
    block = "".join(f"<parameter={k}>\n{v}\n</parameter>\n" for k, v in shown.items())
    assert out["values"].prompt == empty + call.format("f", block) + end
    assert out["blank_answer"].prompt == head.format("r") + call.format("f", "") + end
    assert out["none"].prompt == empty + "a" + end
    assert out["broken"].errors == ["Tool call arguments must be an object."]
    assert out["unnamed"].errors == ["Tool call has no name."]
    assert out["broken"].prompt is None and out["unnamed"].prompt is None
    assert out["not_a_call"].prompt == user("q")
    plain = prompts(spark, {"values": cases["values"]}, PromptOptions(ensure_ascii=False))
    assert '[1, "é"]' in plain["values"].prompt


def test_tool_results(spark):
    ask, call = m("user", "q"), m("assistant", "a")
    r1, r2 = m("tool", " r1 "), m("tool", "r2")
    cases = {
        "one": ([ask, call, r1], None), "two": ([ask, call, r1, r2], None),
        "inside": ([ask, call, r1, r2, call], None), "first": ([r1, ask], None),
    }
    out = {k: r.prompt for k, r in prompts(spark, cases).items()}
    before = user("q") + "<|im_start|>assistant\n<think>\n\n</think>\n\na<|im_end|>\n"
    one = "\n<tool_response>\n{}\n</tool_response>"
    assert out["one"] == before + "<|im_start|>user" + one.format("r1") + "<|im_end|>\n"
    both = before + "<|im_start|>user" + one.format("r1") + one.format("r2") + "<|im_end|>\n"
    assert out["two"] == both
    assert out["inside"] == both + "<|im_start|>assistant\n<think>\n\n</think>\n\na<|im_end|>\n"
    assert out["first"] == one.format("r1") + "<|im_end|>\n" + user("q")


def test_tools_preamble(spark):
    ask = m("user", "q")
    tools = '[{"b":1,"a":"é"},{"name":"x"}]'
    cases = {"with": ([m("system", " s "), ask], tools), "without": ([ask], tools),
             "blank": ([m("system", " "), ask], tools), "no_tools": ([ask], "[]"), "object": ([ask], '{"a":1}')}
    out = {k: r.prompt for k, r in prompts(spark, cases, tools="tools").items()}
    assert out["with"].startswith(
        "<|im_start|>system\n# Tools\n\nYou have access to the following functions:\n\n<tools>\n"
        '{"b": 1, "a": "\\u00e9"}\n{"name": "x"}\n</tools>\n\nIf you choose to call a function ONLY reply')
    assert out["with"].endswith("about function calls\n</IMPORTANT>\n\ns<|im_end|>\n" + user("q"))
    assert out["without"].endswith("</IMPORTANT><|im_end|>\n" + user("q"))
    assert out["blank"] == out["without"]
    assert out["no_tools"] == out["object"] == user("q")


def test_media(spark):
    image, video = "<|vision_start|><|image_pad|><|vision_end|>", "<|vision_start|><|video_pad|><|vision_end|>"
    messages = [
        m("user", parts=[part(image="a"), part(type="text", text=" t "), part(type="video")]),
        m("assistant", "ok"),
        m("user", parts=[part(image_url="b"), part(video="v"), part(type="image")]),
    ]
    plain = prompts(spark, {"x": (messages, None)})["x"].prompt
    assert plain == user(f"{image} t {video}") + "<|im_start|>assistant\nok<|im_end|>\n" + user(image + video + image)
    numbered = prompts(spark, {"x": (messages, None)}, PromptOptions(add_vision_id=True))["x"].prompt
    assert numbered == (user(f"Picture 1: {image} t Video 1: {video}") + "<|im_start|>assistant\nok<|im_end|>\n"
                        + user(f"Picture 2: {image}Video 2: {video}Picture 3: {image}"))
    df = spark.createDataFrame([("x", messages, None)], SCHEMA)
    assert number_media(df).first().contents[1] == "ok"


@pytest.mark.parametrize("thinking_on, tail", [(True, "<think>\n"), (False, "<think>\n\n</think>\n\n")])
def test_generation_prompt(spark, thinking_on, tail):
    options = PromptOptions(add_generation_prompt=True, enable_thinking=thinking_on)
    out = prompts(spark, {"x": ([m("user", "q")], None)}, options)["x"].prompt
    assert out == user("q") + "<|im_start|>assistant\n" + tail


def test_problems(spark):
    ask = m("user", "q")
    cases = {
        "No messages provided.": [],
        "No user query found in messages.": [m("user", "<tool_response></tool_response>")],
        "System message must be at the beginning.": [ask, m("system", "s")],
        "Unexpected message role.": [ask, m("critic", "c")],
        "System message cannot contain images.": [m("system", parts=[part(type="image")]), ask],
        "System message cannot contain videos.": [m("system", parts=[part(video="v")]), ask],
        "Unexpected item type in content.": [m("user", parts=[part(type="audio")])],
        "Unexpected content type.": [m("user", bad=True)],
    }
    df = spark.createDataFrame([(k, v, None) for k, v in cases.items()] + [("null", None, None)], SCHEMA)
    for r in validate(df).collect():
        assert (["No messages provided."] if r.id == "null" else [r.id]) == r.errors
    for r in render(df).collect():
        assert r.prompt is None
    with pytest.raises(PySparkException, match="No messages provided"):
        render(df.where("size(messages) = 0"), strict=True).collect()


def test_thinking_columns(spark):
    df = spark.createDataFrame([("<think>a</think>b", None), ("x", "why")], "text string, given string")
    out = thinking(df, explicit="given").collect()
    assert [(r.reasoning, r.answer) for r in out] == [("a", "b"), ("why", "x")]


def test_turns_arrive_in_any_order(spark):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}.{t}") for c in range(3) for t in range(12)]
    df = spark.createDataFrame(turns[::-1], "conv_id int, turn int, role string, text string").repartition(4)
    for r in group_turns(df, "conv_id", "turn").collect():
        assert [x.content for x in r.messages] == [f"{r.conv_id}.{t}" for t in range(12)]


def test_finetune_shapes(spark):
    schema = ("id string, messages array<struct<role:string,content:string>>, prompt string, completion string, "
              "instruction string, input string, output string, text string, tools string")
    rows = [
        ("messages", [("user", "q")], "p", "c", None, None, None, "t", '[{"a":1}]'),
        ("empty_list", [], "p", "c", "i", None, "o", None, None),
        ("pair", None, "", "c", None, None, None, None, None),
        ("half_pair", None, "p", None, None, None, None, "t", None),
        ("instruction", None, None, None, "i", "x", "o", None, None),
        ("no_input", None, None, None, "i", "", "o", None, None),
        ("text", None, None, None, None, None, None, " raw ", None),
        ("nothing", None, None, None, "i", None, None, None, None),
        ("unrenderable", [("assistant", "a")], None, None, None, None, None, "t", None),
    ]
    df = spark.createDataFrame(rows, schema)
    out = {r.id: r for r in format_rows(df).collect()}
    answer = "<|im_start|>assistant\n<think>\n\n</think>\n\n{}<|im_end|>\n"
    assert out["messages"].prompt == user("q")
    assert out["empty_list"].prompt == user("p") + answer.format("c")
    assert out["pair"].prompt == user("") + answer.format("c")
    assert out["half_pair"].prompt == "t"
    assert out["instruction"].prompt == user("i\nx") + answer.format("o")
    assert out["no_input"].prompt == user("i") + answer.format("o")
    assert out["text"].prompt == " raw "
    assert out["nothing"].prompt is None and "holds no messages" in out["nothing"].errors[0]
    assert out["unrenderable"].errors == ["No user query found in messages."]
    with_tools = {r.id: r for r in format_rows(df, with_tools=True).collect()}
    assert '<tools>\n{"a": 1}\n</tools>' in with_tools["messages"].prompt
    with pytest.raises(PySparkException, match="holds no messages"):
        format_rows(df.where("id = 'nothing'"), strict=True).select("prompt").collect()
    renamed = format_rows(df.select("id", F.col("text").alias("body")), "body")
    assert renamed.where("id = 'text'").first().prompt == " raw "
