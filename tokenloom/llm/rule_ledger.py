"""Quality rules: a ledger of failure bits and measurements, judged by versioned policies.

Every rule is evaluated once a row. The ledger keeps what was measured and one bit per rule that
failed; a policy is a set of rules, so keeping a row, comparing policies and computing what each rule
removes are bitwise operations on the ledger and never read a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import byte_words as bw
from tokenloom.llm.components import checkpointed, text_batches

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks")

# The rules, by bit. Each is a condition on measures under which a row fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "long_words": "word_chars > 40 * n_words",
    "symbols": "100 * n_symbols > 15 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 60 * n_lines",
    "shouting": "n_letters >= 50 and 100 * n_upper > 70 * n_letters",
    "marks": "100 * n_marks > 50 * n_words",
}
# Policies by version: the rules that reject a row.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "long_words", "symbols", "repeated_lines", "shouting", "marks"),
}
BASE, CURRENT = "v1", "v2"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str | tuple[str, ...]) -> int:
    rules = POLICIES[policy] if isinstance(policy, str) else policy
    return reduce(int.__or__, map(bit, rules), 0)


def _repeated_words(runs: np.ndarray, n: int) -> int:
    """Words covered by windows of ``n`` words that occur twice or more; ``runs`` are the windows' hashes."""
    order = np.argsort(runs, kind="stable")
    same = runs[order[1:]] == runs[order[:-1]]
    twice = np.zeros(len(runs), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    change = np.zeros(len(runs) + n, np.int64)
    at = np.flatnonzero(twice)
    change[at] += 1
    change[at + n] -= 1
    return int((np.cumsum(change) > 0).sum())


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """``id_col`` and MEASURES of every row. Null and empty texts have one line and no words."""
    upper, letters, marks = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    upper[65:91] = letters[65:91] = letters[97:123] = True
    marks[ord("!")] = True
    symbols = np.zeros(256, bool)
    symbols[list(b"#*$%&|<>")] = True
    lead = (np.arange(256) & 0xC0) != 0x80

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, data, offsets in bw.slices(batch.column(1)):
                rows = len(offsets) - 1
                per_row = lambda flags: np.diff(np.append(0, np.cumsum(flags))[offsets])
                starts, ends, first = bw.word_spans(data, offsets)
                sums = bw.prefix_hash(data)
                runs = bw.joined_hashes(bw.span_hash(sums, starts, ends), n)
                repeats = [_repeated_words(runs[a:b - n + 1], n) if b - a > n else 0
                           for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                breaks = np.flatnonzero(data == 10)
                line = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
                line = line[line < len(data)]
                owner = np.searchsorted(offsets, line, "right") - 1
                line_end = np.minimum(np.append(line[1:], len(data)), offsets[owner + 1])
                line_end -= (data[line_end - 1] == 10) & (line_end > line) if len(line) else 0
                worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line)
                key = bw.mix(bw.span_hash(sums, line, line_end) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[worded]
                order = np.argsort(key, kind="stable")
                again = np.zeros(len(key), bool)
                again[order[1:]] = key[order[1:]] == key[order[:-1]]
                copies = np.bincount(owner[worded][again], minlength=rows)
                values = [np.diff(first), per_row(lead[data] & ~bw.SPACE[data]), per_row(symbols[data]), per_row(data == 10) + 1, copies, repeats,
                          per_row(upper[data]), per_row(letters[data]), per_row(marks[data])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, rows), *[pa.array(np.asarray(v, np.int64)) for v in values]], ["id", *MEASURES])

    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)).withColumnRenamed("id", id_col)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, MEASURES and ``failures``, the bits of the rules that each row fails.

    Repeated rows and null ids keep a row each; extra columns are ignored.
    """
    bits = [F.when(F.expr(condition), F.lit(bit(rule))).otherwise(0) for rule, condition in RULES.items()]
    failures = reduce(Column.bitwiseOR, bits).cast("long")
    return measure(docs, id_col, text_col).withColumn("failures", failures)


def passes(policy: str | tuple[str, ...], failures: Column | None = None) -> Column:
    """Whether a ledger row fails none of the policy's rules."""
    failures = F.col("failures") if failures is None else failures
    return failures.bitwiseAND(F.lit(mask(policy))) == 0


def sole_rule(policy: str | tuple[str, ...], failures: Column | None = None) -> Column:
    """The rule that alone rejects a ledger row; null where none or several do."""
    failures = F.col("failures") if failures is None else failures
    rules = POLICIES[policy] if isinstance(policy, str) else policy
    own = failures.bitwiseAND(F.lit(mask(policy)))
    return F.coalesce(*[F.when(own == bit(r), F.lit(r)) for r in rules], F.lit(None).cast("string"))


def judged(docs: DataFrame, base: str = BASE, current: str = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger, stored once, with base_failed, kept, sole_rule and sole_rows.

    Everything but the measures is told from the stored bits: both policies, the rule of the current one that alone
    rejects a row, and from the ablation how many rows that rule alone rejects (null where there is no such rule).
    """
    book = checkpointed(ledger(docs, id_col, text_col))
    only = ablations(book, current).select(F.col("rule").alias("sole_rule"), F.col("only").alias("sole_rows"))
    told = book.withColumns({"base_failed": ~passes(base), "kept": passes(current), "sole_rule": sole_rule(current)})
    return told.join(F.broadcast(only), "sole_rule", "left")  # one row a rule


def ablations(book: DataFrame, policy: str | tuple[str, ...] = CURRENT) -> DataFrame:
    """``rule``, ``failed``, ``only``, ``kept_without``: what each rule of a policy removes, alone or at all.

    The ledger is first counted by failure bits, so the rest works on at most 2 ** rules rows.
    """
    rules = POLICIES[policy] if isinstance(policy, str) else policy
    counted = book.groupBy(F.col("failures").bitwiseAND(F.lit(mask(rules))).alias("bits")).agg(F.count("*").alias("n"))
    table = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in rules]))
    each = counted.select("bits", "n", table.alias("r")).select("bits", "n", "r.rule", "r.bit")
    rest = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(failed & (rest == 0), F.col("n")).otherwise(0)).alias("only"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("kept_without"))
