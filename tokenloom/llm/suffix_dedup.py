"""Suffix-array dedup: a depth-limited radix sort of suffixes by most-significant-digit passes.

Only the first ``depth`` tokens of a suffix count, and groups that are equal to that depth are exactly
the repeated windows. Tokens are bytes for what is removed, words for the passages that are reported.
Sorting every suffix would move a row per byte. Suffixes are therefore taken in
zones of neighbours around content-defined anchors (`window_digits`). A pass groups zones by their
core, the digit; a zone alone in its group drops out, as a suffix alone in its radix bucket does. Zones
with an equal context are repeated in every window at once. What is left, zones that share the core
but not the context, goes on to the next pass in smaller zones, then single windows. Contexts are equal when
both of their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import byte_words as bw
from tokenloom.llm import fixed_filter
from tokenloom.llm import window_digits as wd
from tokenloom.llm.components import checkpointed, owned, row_reference, text_batches

NAMES = ["r", "low", "high", "anchor", "core", "context", "check"]
ZONE = ", ".join(f"{name} long" for name in NAMES)
GROUP = "r long, low long, high long, anchor long, same boolean, apart boolean, stands boolean, mixed boolean"
GROUP_NAMES = [field.split()[0] for field in GROUP.split(", ")]
#: A group is hot from this many rows, or this share of all rows if that is more; so there are at most HOT_GROUPS.
HOT_ROWS, HOT_GROUPS = 2_000, 50_000
#: Cores are counted in so many buckets; a bucket that is not hot holds no hot group.
BUCKETS = 1 << 16
SPREAD = 64
#: Rows one task sorts at a time, and bytes of text it takes at a time (what fits a processor's cache).
SORT_ROWS, SLICE_BYTES = 250_000, 1 << 17
WORDS = 50


@dataclass(frozen=True)
class Tokens:
    """How a flat byte array becomes token codes with row offsets, and the windows over them."""

    codes: Callable[[np.ndarray, np.ndarray], tuple[wd.Lanes, np.ndarray]]
    shape: wd.Shape


def byte_tokens(depth: int) -> Tokens:
    return Tokens(lambda data, offsets: (wd.byte_codes(data), offsets), wd.byte_shape(depth))


def word_tokens(depth: int) -> Tokens:
    def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[wd.Lanes, np.ndarray]:
        starts, ends, first = bw.word_spans(data, offsets)
        return wd.word_codes(bw.word_hashes(data, starts, ends)), first

    return Tokens(codes, wd.word_shape(depth))


def _table(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _first_pass(rows: DataFrame, tokens: Tokens) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs = batch.column(0).to_numpy()
            for first, data, offsets in bw.slices(batch.column(1), SLICE_BYTES):
                row, *zone = wd.first_zones(*tokens.codes(data, offsets), tokens.shape)
                if len(row):
                    yield _table([refs[first + row], *zone], NAMES)

    return rows.select("r", "text").mapInArrow(run, ZONE)


def _lists(column: pa.ListArray, first: int, rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row (from 0) and fields of each entry in the lists of ``rows`` rows from ``first``."""
    bounds = column.offsets.to_numpy()[first:first + rows + 1]
    values = column.values.slice(bounds[0], bounds[-1] - bounds[0])
    return np.repeat(np.arange(rows), np.diff(bounds)), [x.to_numpy() for x in values.flatten()]


def _next_pass(rows: DataFrame, open_: DataFrame, tokens: Tokens, step: int) -> DataFrame:
    """Finer zones of ``open_``; only rows that may hold some are moved."""
    table = fixed_filter.build(open_.select(F.col("r").alias("key")))
    lists = open_.groupBy("r").agg(F.collect_list(F.struct("low", "high", "anchor")).alias("zones"))
    texts = rows.where(fixed_filter.may_hold(F.col("r"), table)).select("r", "text")
    joined = texts.join(lists, "r").select("r", "text", "zones")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs = batch.column(0).to_numpy()
            for first, data, offsets in bw.slices(batch.column(1), SLICE_BYTES):
                codes, starts = tokens.codes(data, offsets)
                row, places = _lists(batch.column(2), first, len(offsets) - 1)
                row, *places = wd.distinct_zones(row, *places)
                of, *found = wd.finer_zones(codes, starts[row], *places, tokens.shape.depth, step)
                yield _table([refs[first + row[of]], *found], NAMES)

    return joined.mapInArrow(run, ZONE)


def _with_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` with their group's row, if they have one. Groups of many rows, a bounded number, are handed to the
    tasks, so that the rows of a hot group stay where they are; the others meet by a shuffle."""
    hot = F.broadcast(groups.where(F.col(size) > max(HOT_ROWS, total // HOT_GROUPS)))
    cold = rows.join(hot.select(*keys), keys, "left_anti")
    return cold.join(groups, keys).unionByName(rows.join(hot, keys))


def _dealt(zones: DataFrame, total: int, across: bool) -> DataFrame:
    """``zones`` with ``told`` (bits of ``wd.equal_zones``) and ``digit``, by which they are dealt out.

    A zone goes by its core, in a hot group by its context too, and where one context is hot anywhere: then told
    says all, from aggregates that combine on the map side. Only buckets of many rows, a bounded number, can hold hot groups.
    """
    most = max(HOT_ROWS, total // HOT_GROUPS)
    bucket = F.pmod("core", F.lit(BUCKETS))
    hot = zones.groupBy(bucket.alias("b")).count().where(F.col("count") > most).select("b").collect()
    if not hot:
        return zones.withColumn("told", F.lit(0).cast("long")).withColumn("digit", F.col("core"))
    place, keys = F.xxhash64("r", "low"), ["core", "context", "check"]
    many = zones.where(F.expr(f"pmod(core, {BUCKETS}) in ({', '.join(str(x['b']) for x in hot)})"))
    kinds = checkpointed(many.groupBy(*keys).agg(F.count("*").alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min(place).alias("one")))
    cores = kinds.groupBy("core").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).where(F.col("n") > most)
    cores = cores.select("core", F.when(F.col("kinds") > 1, 3).otherwise(1).alias("group"))
    kinds = kinds.where(F.col("n") > most).drop("n")
    met = zones.join(F.broadcast(cores), "core", "left").join(F.broadcast(kinds), keys, "left")
    stands = (F.col("r") == F.col("r0")) | (F.col("r") == F.col("r1")) if across else place == F.col("one")
    kind = 4 + F.when(F.col("r0") != F.col("r1"), 8).otherwise(0) + F.when(stands, 16).otherwise(0)
    told = F.coalesce("group", F.lit(0)) + F.when(F.col("one").isNotNull(), kind).otherwise(0)
    # copies of one place, which repeated rows have, meet in at most SPREAD tasks
    spread = F.xxhash64("r", "low", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)))
    digit = F.when(F.col("one").isNotNull(), spread).when(F.col("group").isNotNull(), F.xxhash64(*keys)).otherwise(F.col("core"))
    return met.select(*NAMES, told.cast("long").alias("told"), digit.alias("digit"))


def _grouped(zones: DataFrame, across: bool) -> DataFrame:
    """Zones not alone in their group: ``same``, whether others share the context, ``apart``, whether in several
    rows, ``stands`` (for those: one of them, or those of two rows if ``across``), ``mixed``.

    Zones are dealt out by their digit and sorted within the tasks. Places that repeated rows share come at most SPREAD times.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            yield _table(wd.equal_zones(*[c.to_numpy() for c in pa.Table.from_batches(held).columns], across), GROUP_NAMES)

    zones, forget_zones = owned(zones)
    total = zones.count()
    dealt = _dealt(zones, total, across).repartition(total // SORT_ROWS + 1, "digit")
    out = checkpointed(dealt.select(*NAMES, "told").mapInArrow(run, GROUP), free=True)
    forget_zones()
    return out


def repeated_spans(rows: DataFrame, tokens: Tokens, across: bool = False) -> DataFrame:
    """``r``, ``low``, ``end``: token spans of ``rows`` (r, text) made of windows that start elsewhere too, in
    another row if ``across``.

    Of zones known to be repeated one goes on, for the others' sake. Where only repeats in other rows count, those
    repeated in their own row alone all go on, of the others two from different rows.
    """
    spans = []
    depth = tokens.shape.depth
    groups = _grouped(_first_pass(rows, tokens), across)
    for step in (tokens.shape.step, 1, 0):
        spans.append(groups.where("apart" if across else "same").select("r", "low", (F.col("high") + depth).alias("end")))
        open_ = groups.where("mixed and (not apart or stands)" if across else "mixed and stands")
        if not step:
            break
        groups = _grouped(_next_pass(rows, open_, tokens, step), across)
    return spans[0].unionByName(spans[1]).unionByName(spans[2])


def repeated_words(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """``r``, ``n_shared_words``: words of ``rows`` (r, text) in windows of ``words`` words that other rows have too."""
    spans = repeated_spans(rows, word_tokens(words), across=True)
    lists = spans.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("low", "end"))).alias("spans"))
    # spans go by their start, so what a span adds is what lies beyond the furthest end so far
    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("spans", none, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["end"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["low"]))).alias("n")), lambda acc: acc["n"])
    return checkpointed(lists.select("r", covered.alias("n_shared_words")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 400,
                   with_text: bool = True, words: int | None = None) -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes left) and spans.

    With ``words`` also n_shared_words: the words of the text in passages of so many words that other rows hold
    too, however white space differs. Nothing is removed for it.

    A byte goes when a string of ``depth`` bytes that covers it also starts elsewhere, in this text or
    another. Texts are UTF-8 bytes; null is empty; texts shorter than ``depth`` stay whole. Each row is
    a text of its own, so of repeated rows (equal ids or not) all long ones go. Extra columns are
    ignored; null ids keep their row.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("r", row_reference(F.col("id"), F.col("text")))
    spans = checkpointed(repeated_spans(rows.where(F.octet_length("text") >= depth), byte_tokens(depth)))
    table = fixed_filter.build(spans.select(F.col("r").alias("key")))
    lists = spans.groupBy("r").agg(F.collect_list(F.struct("low", "end")).alias("spans"))
    touched = fixed_filter.may_hold(F.col("r"), table)
    marked = rows.withColumn("touched", touched)
    plain = marked.where(~F.col("touched")).select("id", "text", "r", F.lit(None).cast(lists.schema["spans"].dataType).alias("spans"))
    cut = marked.where("touched").join(lists, "r", "left").select("id", "text", "r", "spans")
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        schema += ", kept binary, spans array<struct<low:bigint,end:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in bw.slices(batch.column(1), SLICE_BYTES):
                n, view = len(offsets) - 1, memoryview(data)
                row, (low, end) = _lists(batch.column(2), first, n)
                # one position lies between two rows, so their runs stay apart
                base = offsets[:-1] + np.arange(n)
                low, end = wd.merged(low + base[row], end + base[row])
                row = np.searchsorted(base, low, "right") - 1
                low, end = low - row, end - row
                runs = np.bincount(row, minlength=n)
                gone = np.append(0, np.cumsum(end - low))
                last = np.cumsum(runs)
                removed = gone[last] - gone[last - runs]
                digest, left, where = [], [], []
                for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), (last - runs).tolist(), last.tolist(), strict=True):
                    cuts = [a, *np.stack((low[i:j], end[i:j]), 1).ravel().tolist(), b] if j > i else [a, b]
                    parts = [view[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)]
                    kept = hashlib.sha256()
                    for part in parts:
                        kept.update(part)
                    digest.append(kept.hexdigest())
                    if with_text:
                        left.append(b"".join(parts))
                        where.append([{"low": x - a, "end": y - a} for x, y in zip(cuts[1:-1:2], cuts[2::2], strict=True)])
                columns = [batch.column(0).slice(first, n), pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs, pa.int64()), pa.array(digest, pa.string())]
                if with_text:
                    columns += [pa.array(left, pa.binary()), pa.array(where, pa.list_(pa.struct([("low", pa.int64()), ("end", pa.int64())])))]
                out = names[:len(columns)]
                if words is not None:
                    columns, out = [*columns, batch.column(3).slice(first, n)], [*out, "r"]
                yield pa.RecordBatch.from_arrays(columns, out)

    found = plain.unionByName(cut).select("id", "text", "spans", "r")
    if words is None:
        return found.mapInArrow(run, schema).withColumnRenamed("id", id_col)
    shared = repeated_words(rows.where(F.octet_length("text") >= 2 * words - 1), words)
    told = found.mapInArrow(run, schema + ", r long")
    told = told.join(shared, "r", "left").withColumn("n_shared_words", F.coalesce("n_shared_words", F.lit(0)).cast("long"))
    return told.select(F.col("id").alias(id_col), *[c for c in told.columns if c not in ("id", "r", "n_shared_words")], "n_shared_words")
