"""Conversation repair against a shortest-path search over edits, and its spans."""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest

from tokenloom.llm import conversation_repair as repair
from tokenloom.llm import repair_cyk as cyk
from tokenloom.llm.conversation_repair import damaged, repair_conversations, repaired_rows

BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired lines) by a shortest-path search; rows are (role, text, fault)."""
    heap = [(0, "", 0, 0, ())]  # cost, audit, rows done, 0 start / 1 after s / 2 after u / 3 after a, lines
    seen = set()
    while True:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, audit, lines
        want = "assistant" if state == 2 else "user"
        after = 3 if state == 2 else 2
        heapq.heappush(heap, (cost + 5, audit + "I", at, after, (*lines, (want, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, lines))
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, after, (*lines, (want, text))))
                if role[:1] == want[0]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, after, (*lines, (role, text))))
                if role[:1] == "s" and state == 0:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, 1, (*lines, (role, text))))


def fault_of(text, repeated):
    bare = text.strip(BLANKS)
    return "blank" if not bare else "duplicate" if repeated else "" if bare[-1] in ".!?" else "truncated"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        out += [(conv, turn, role, text, case == 0)] * (2 if case == 3 else 1)
    return out


def plain_repair(rows):
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, digest; and the mended rows."""
    convs = defaultdict(list)
    for conv, turn, role, text, gone in rows:
        convs[conv]
        if not gone:
            convs[conv].append((turn, role, text))
    out, mended = Counter(), {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, plain.sha(f"{r[1]}\0{r[2]}".encode())))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [fault_of(text, (role, text) in [r[1:] for r in own[:k]]) for k, (_, role, text) in enumerate(own)]
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest([(r[1], r[2], f) for r, f in zip(own, faults, strict=True)])
        mended[conv] = list(lines)
        digest = plain.sha("\n".join(f"{r}:{t}" for r, t in lines).encode())
        out[conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), bad, cost, audit, digest] += 1
    return out, mended


def awkward_rows():
    rng = np.random.default_rng(6)
    roles = ["user", "assistant", "system", "tool", "", None, "student", "agent"]
    texts = ["Fine.", "Yes!", "cut", " \t\n", "", None, "Really?  \n", "é日本 🙂.", "a" * 5000, "\x85", "Fine."]
    rows = []
    for conv in range(60):
        for turn in range(int(rng.integers(1, 9))):
            odd = rng.random()
            rows.append((conv, None if odd < 0.05 else turn + int(odd > 0.9), roles[rng.integers(0, 8 if odd > 0.7 else 2)], texts[rng.integers(0, len(texts))]))
    rows += [(100, t, ("user", "assistant")[t % 2 if rng.random() > 0.2 else 0], f"turn {rng.integers(0, 150)}{'.' * int(rng.random() > 0.1)}") for t in range(180)]
    rows += [(101, None, "user", "same.")] * 70 + [(None, 1, "user", "a."), (None, None, None, None), (102, 5, "system", "only.")]
    return rows


def as_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, cost int, part string, audit string").repartition(3)


@pytest.mark.parametrize("span, partitions", [(16, None), (2, 9), (3, 40)])
def test_repair(spark, monkeypatch, span, partitions):
    """Spans of every size; one conversation over many spans and partitions."""
    monkeypatch.setattr(repair, "SPAN", span)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    if partitions:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = awkward_rows()
        expected, mended = plain_repair(plain_damage(rows))
        found = repair_conversations(damaged(as_frame(spark, rows)))
        assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert Counter(map(tuple, found.collect())) == expected
        made = defaultdict(list)
        for r in repaired_rows(damaged(as_frame(spark, rows))).orderBy("conv_id", "place").collect():
            made[r.conv_id].append((r.role, r.text))
        assert made == {c: lines for c, lines in mended.items() if lines}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_empty_and_gone(spark):
    df = as_frame(spark, awkward_rows())
    assert repair_conversations(df.where("false")).count() == 0
    gone = repair_conversations(df.selectExpr("*", "true as gone")).collect()
    assert {tuple(r)[1:] for r in gone} == {(0, 0, 0, 0, 0, 0, "", plain.sha(b""))}


def test_every_short_sequence():
    """All sequences of up to four symbols against the search; every repair spells the pattern."""
    roles = {"s": "system", "u": "user", "a": "assistant", "-": "tool"}
    for n in range(5):
        for symbols in itertools.product("suaUA_x", repeat=n):
            rows = [(roles.get(s.lower(), "tool"), "t", "blank" if s == "x" else "truncated" if s in "UA_" else "") for s in symbols]
            cost, audit, lines = cheapest(rows)
            assert cyk.answer(cyk.parse_symbols("".join(symbols))) == (cost, audit)
            mended = cyk.repaired(audit, cyk.START, [r[0] for r in rows], [r[1] for r in rows])
            assert tuple(mended) == lines
            assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in mended))


def test_one_split_equals_all():
    """Cells of neighbouring parts combine to the same cell wherever a span is cut."""
    rng = np.random.default_rng(2)
    for _ in range(40):
        symbols = "".join(rng.choice(list("suaUA_x-"), 10))
        for at in range(1, 10):
            assert cyk.parse([cyk.parse_symbols(symbols[:at]), cyk.parse_symbols(symbols[at:])]) == cyk.parse_symbols(symbols)
