"""Conversation structure repair by weighted CYK interval parsing.

Rows are range-sorted by (conversation, turn), and each partition is read as a stream that is cut into spans of
at most ``SPAN`` rows. A conversation that lies in one span is parsed where it is read (`repair_cyk`). Longer
ones, and those at a partition's border, leave their spans as table rows: repeated texts are told by an
aggregate, each span is parsed to one cell, and cells of neighbouring spans are combined ``SPAN`` at a time,
short spans first, round by round. The winning audit goes back to the spans as pieces, which mend their
rows. So no task holds a long conversation's texts; what one task sees of it are its audits, and, for the
digest, its mended rows one span after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import repair_cyk as cyk
from tokenloom.llm.components import checkpointed, text_batches
from tokenloom.operators.indexing import join_on

SPAN = 16
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
CELL = "array<struct<p:int,q:int,cost:bigint,audit:string>>"
ROWS = "array<struct<role:string,text:string>>"
_ROW_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_CELL_TYPE = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``rows`` with faults by crc32 of ``id:turn`` modulo 20: 0 drops a row (kept here, marked ``gone``), 1 empties
    its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's. Nulls count as one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(spaced(id_col), F.lit(":"), spaced(turn_col)).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate(spaced(text_col), ".!?", "")).otherwise(spaced(text_col))
    role = F.when(case == 4, "user").otherwise(spaced(role_col))
    out = rows.select(F.col(id_col), F.col(turn_col), role.alias(role_col), text.alias(text_col), (case == 0).alias("gone"),
                      F.explode(F.array_repeat(F.lit(0), F.when(case == 3, 2).otherwise(1).cast("int"))).alias("copy"))
    return out.drop("copy")


def _batch(out: list[tuple], first: pa.DataType, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [first, *types], strict=True)], names)


def _fault(text: str, repeated: bool) -> str:
    bare = text.rstrip(BLANKS)
    if not bare:
        return "blank"
    if repeated:
        return "duplicate"
    return "" if bare[-1] in ".!?" else "truncated"


def _symbol(role: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return "x"
    first = role[:1] if role[:1] in ("s", "u", "a") else "-"
    return {"-": "_"}.get(first, first.upper()) if fault else first


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, int, bool, list[tuple]]]:
    """(conversation, partition, number of the conversation's span there, whole, rows) of a sorted partition."""
    held: list[tuple] = []
    conv, part, seq, edge = None, 0, 0, True
    started = False
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if started and row[0] != conv:
                yield conv, part, seq, seq == 0 and not edge, held
                held, seq, edge = [], 0, False
            elif len(held) == SPAN:
                yield conv, part, seq, False, held
                held, seq = [], seq + 1
            conv, part, started = row[0], row[6], True
            if not row[5]:
                held.append(row)
    if started:
        yield conv, part, seq, False, held


def _first_pass(rows: DataFrame, with_rows: bool) -> DataFrame:
    kind = rows.schema["conv"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    schema = (f"conv {kind}, part int, seq long, ref long, whole boolean, {counts}, audit string, repaired_sha256 string, rows {ROWS}, "
              "turns array<long>, roles array<string>, texts array<string>, keys array<binary>")
    types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * len(COUNTS), pa.string(), pa.string(), _ROW_TYPE,
             pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.binary())]

    def told(ref: int, conv: object, part: int, seq: int, whole: bool, held: list[tuple]) -> tuple:
        turns, roles, texts, keys = ([r[i] for r in held] for i in (1, 2, 3, 4))
        if not whole:
            return (conv, part, seq, (part << 33) + ref, False, *[None] * len(COUNTS), None, None, None, turns, roles, texts, keys)
        known = [t for t in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        seen: set[bytes] = set()
        faults = []
        for text, key in zip(texts, keys, strict=True):
            faults.append(_fault(text, key in seen))
            seen.add(key)
        cost, audit = cyk.answer(cyk.parse_symbols("".join(map(_symbol, roles, faults))))
        mended = cyk.repaired(audit, cyk.START, roles, texts)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in mended).encode()).hexdigest()
        made = [{"role": r, "text": t} for r, t in mended] if with_rows else None
        return (conv, part, seq, (part << 33) + ref, True, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                cyk.illegal([r[:1] for r in roles]), cost, audit, digest, made, None, None, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal first
            for batch in batches:
                first = batch.column(0).type
                yield batch

        out: list[tuple] = []
        size = 0
        for ref, span in enumerate(_spans(typed())):
            out.append(told(ref, *span))
            size += sum(len(r[3]) for r in span[4])
            if len(out) >= 2000 or size > 1 << 22:
                yield _batch(out, first, types, names)
                out, size = [], 0
        if out:
            yield _batch(out, first, types, names)

    names = ["conv", "part", "seq", "ref", "whole", *COUNTS, "audit", "repaired_sha256", "rows", "turns", "roles", "texts", "keys"]
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("key")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpointed(placed.select("conv", "turn", "role", "text", "key", "gone", F.spark_partition_id().alias("part")).mapInArrow(run, schema))


def _parsed_spans(spans: DataFrame) -> DataFrame:
    """``spans`` (conv, part, seq, ...) with symbols, counts, initials at both ends and the cell."""
    kind = spans.schema["conv"].dataType.simpleString()
    at = spans.select("conv", "ref", F.posexplode("keys").alias("at", "key"))
    first = at.groupBy("conv", "key").agg(F.min(F.struct("ref", "at")).alias("at")).select("at.*")
    firsts = first.groupBy("ref").agg(F.collect_list("at").alias("firsts"))
    joined = spans.join(firsts, "ref", "left").select("conv", "part", "seq", "ref", "roles", "texts", "firsts")
    names = ["conv", "part", "seq", "ref", "symbols", "blank", "duplicate", "truncated", "illegal", "head", "tail", "cell"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), _CELL_TYPE]
    schema = f"conv {kind}, part int, seq long, ref long, symbols string, blank long, duplicate long, truncated long, illegal long, head string, tail string, cell {CELL}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, part, seq, ref, roles, texts, firsts in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                new = set(firsts or [])
                faults = [_fault(text, k not in new) for k, text in enumerate(texts)]
                symbols = "".join(map(_symbol, roles, faults))
                initials = [r[:1] for r in roles]
                out.append((conv, part, seq, ref, symbols, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), cyk.illegal(initials),
                            initials[0] if initials else None, initials[-1] if initials else None, cyk.flat(cyk.parse_symbols(symbols))))
            yield _batch(out, batch.column(0).type, types, names)

    return checkpointed(joined.mapInArrow(run, schema))


def _combined(cells: DataFrame, by_part: bool) -> DataFrame:
    """One cell for ``SPAN`` neighbours each: spans of one partition, or (``by_part``) partitions, numbered anew."""
    kind = cells.schema["conv"].dataType.simpleString()
    run_of = F.floor(F.col("part" if by_part else "seq") / SPAN)
    keyed = cells.withColumn("to_part", (run_of if by_part else F.col("part")).cast("int")).withColumn("to_seq", (F.lit(0) if by_part else run_of).cast("long"))
    parts = F.sort_array(F.collect_list(F.struct("part", "seq", "illegal", "head", "tail", "cell")))
    grouped = keyed.groupBy("conv", "to_part", "to_seq").agg(parts.alias("parts"))
    schema = f"conv {kind}, part int, seq long, illegal long, head string, tail string, cell {CELL}"
    names = ["conv", "part", "seq", "illegal", "head", "tail", "cell"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), _CELL_TYPE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, part, seq, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ends = [(p["head"], p["tail"]) for p in parts if p["head"] is not None]
                between = sum(cyk.illegal([tail, head]) for (_, tail), (head, _) in zip(ends, ends[1:]))
                out.append((conv, part, seq, sum(p["illegal"] for p in parts) + between, ends[0][0] if ends else None, ends[-1][1] if ends else None,
                            cyk.flat(cyk.parse([cyk.thick(p["cell"]) for p in parts]))))
            yield _batch(out, batch.column(0).type, types, names)

    return checkpointed(grouped.mapInArrow(run, schema))


def _answers(cells: DataFrame) -> DataFrame:
    """``conv``, illegal, cost, audit from the cells of its spans (conv, part, seq, illegal, head, tail, cell)."""
    most = cells.agg(F.max("seq")).first()[0] or 0
    while most:
        cells, most = _combined(cells, by_part=False), most // SPAN
    first = cells.groupBy("conv").agg(F.min("part").alias("first"))
    cells = join_on(cells, first, ["conv"]).withColumn("part", F.col("part") - F.col("first")).drop("first")
    most = cells.agg(F.max("part")).first()[0] or 0
    while most:
        cells, most = _combined(cells, by_part=True), most // SPAN
    kind = cells.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(conv, illegal, *cyk.answer(cyk.thick(cell))) for conv, illegal, cell in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield _batch(out, batch.column(0).type, [pa.int64(), pa.int64(), pa.string()], ["conv", "illegal", "cost", "audit"])

    return checkpointed(cells.select("conv", "illegal", "cell").mapInArrow(run, f"conv {kind}, illegal long, cost long, audit string"))


def _mended(spans: DataFrame, symbols: DataFrame, answers: DataFrame) -> DataFrame:
    """``conv``, ref, rows: every span's rows after repair."""
    kind = spans.schema["conv"].dataType.simpleString()
    lists = symbols.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("ref", "symbols"))).alias("spans"))
    told = join_on(lists, answers.select("conv", "audit"), ["conv"]).select("spans", "audit")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for spans, audit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                symbols = [s["symbols"] for s in spans]
                found = cyk.pieces(audit, [len(s) for s in symbols], symbols)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s["ref"] for s in spans], pa.int64()), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.int32())],
                    ["ref", "audit", "state"])

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, ref, roles, texts, audit, state in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                out.append((conv, ref, [{"role": r, "text": t} for r, t in cyk.repaired(audit, state, roles, texts)]))
            yield _batch(out, batch.column(0).type, [pa.int64(), _ROW_TYPE], ["conv", "ref", "rows"])

    pieces = told.mapInArrow(cut, "ref long, audit string, state int")
    joined = spans.join(pieces, "ref").select("conv", "ref", "roles", "texts", "audit", "state")
    return checkpointed(joined.mapInArrow(mend, f"conv {kind}, ref long, rows {ROWS}"))


def _digests(mended: DataFrame) -> DataFrame:
    """``conv``, repaired_sha256. The digest of one conversation is a chain, so its spans pass one task, one by one."""
    kind = mended.schema["conv"].dataType.simpleString()
    names = ["conv", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, empty, started, type_ = None, hashlib.sha256(), True, False, None
        for batch in batches:
            type_, out = batch.column(0).type, []
            for now, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if started and now != conv:
                    out.append((conv, digest.hexdigest()))
                    digest, empty = hashlib.sha256(), True
                conv, started = now, True
                for row in rows:
                    digest.update(f"{'' if empty else chr(10)}{row['role']}:{row['text']}".encode())
                    empty = False
            if out:
                yield _batch(out, type_, [pa.string()], names)
        if started:
            yield _batch([(conv, digest.hexdigest())], type_, [pa.string()], names)

    ordered = mended.repartition("conv").sortWithinPartitions("conv", "ref").select("conv", "rows")
    return ordered.mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def _repair(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, with_rows: bool) -> tuple[DataFrame, DataFrame]:
    """(a row for each conversation, mended rows: conv, ref, rows)."""
    text_batches(rows.sparkSession)
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    given = rows.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"), gone.alias("gone"))
    given = given.withColumn("key", F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text").cast("binary"), 256)))
    given = given.withColumn("text", F.when(~F.col("gone"), F.col("text")))
    spans = _first_pass(given, with_rows)
    whole = spans.where("whole")
    rest = spans.where("not whole").select("conv", "part", "seq", "ref", "turns", "roles", "texts", "keys")
    symbols = _parsed_spans(rest)
    answers = _answers(symbols.select("conv", "part", "seq", "illegal", "head", "tail", "cell"))
    mended = _mended(rest, symbols, answers)
    turns = rest.select("conv", F.explode_outer("turns").alias("turn")).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    sums = symbols.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    long = join_on(join_on(join_on(answers, turns, ["conv"]), sums, ["conv"]), _digests(mended), ["conv"])
    columns = ["conv", *COUNTS, "audit", "repaired_sha256"]
    made = whole.select("conv", "ref", "rows").unionByName(mended)
    return whole.select(*columns).unionByName(long.select(*columns)), made


def repair_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id_col``, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    The repaired role initials spell ``(s?(ua)+)?``. Keeping a row is free, making it a user's or an
    assistant's costs 1, deleting it 2, inserting one without text 5; a truncated row that stays costs 5 more, blank
    and repeated ones must go. ``audit`` has an initial for each edit (K, R, D, I); of equally cheap ones it is the
    least in ASCII.

    Rows go by turn, null first; rows of one turn by the SHA-256 of role and text. Null roles and texts
    count as one space. Null is a conversation of its own. Rows marked in a boolean column ``gone`` only tell that
    their conversation exists: without other rows it has zeros, an empty audit and the digest of an empty text. An
    empty table gives an empty one. Other columns are ignored.
    """
    return _repair(rows, id_col, turn_col, role_col, text_col, False)[0].withColumnRenamed("conv", id_col)


def repaired_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows after repair: ``id_col``, place (sorts a conversation's rows), ``role_col``, ``text_col``."""
    made = _repair(rows, id_col, turn_col, role_col, text_col, True)[1]
    flat = made.select("conv", "ref", F.posexplode("rows").alias("at", "row"))
    return flat.select(F.col("conv").alias(id_col), F.struct("ref", "at").alias("place"), F.col("row.role").alias(role_col), F.col("row.text").alias(text_col))
