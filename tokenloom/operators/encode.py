"""Dictionary encoding of a text column."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom import kernels
from tokenloom.functions.text import PRETOKENS, WORDS, pieces, pieces_with_special
from tokenloom.operators.indexing import with_row_index
from tokenloom.schemas import IDS
from tokenloom.session import text_batches
from tokenloom.sources.special import special_ids
from tokenloom.staging import stage


HEAD_ENTRIES, SHORT = 1_000_000, 64
HEAD_LONG, LONG = 10_000, 4096
KNOWN = T.StructType([T.StructField("ids", IDS), T.StructField("missing", T.ArrayType(T.StringType()))])


class Encoder(Protocol):
    """Turns a text column into token ids without special tokens added."""

    def encode(self, df: DataFrame, text_column: str = "text", out: str = "ids") -> DataFrame:
        """``df`` plus ``out ARRAY<INT>``; one row per input row."""


def build_dictionary(df: DataFrame, text_column: str = "text", pattern: str = WORDS,
                     first_id: int = 1, special: list[str] | None = None) -> DataFrame:
    """``(token, n, id)`` from the corpus: ids by falling count, then by token.

    Counting combines on the map side, so frequent pieces shuffle one row per task. Numbering is
    range-partitioned, the dictionary may be of any size.
    """
    found = _pieces(F.col(text_column), pattern, special)
    counts = df.select(F.explode(found).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    if special:
        counts = counts.where(~F.col("token").isin(special))
    ranked = with_row_index(counts, [F.desc("n"), F.col("token")], "_rank")
    return ranked.select("token", "n", (F.col("_rank") + first_id).alias("id"))


def _pieces(text: Column, pattern: str, special: list[str] | None) -> Column:
    return pieces_with_special(text, special, pattern) if special else pieces(text, pattern)


class DictionaryEncoder:
    """Encoder over a ``(token, id)`` dictionary of any size.

    Its most frequent part (smallest ids) is handed to the tasks as Arrow arrays, and texts are looked up in
    place by Arrow batches: no shuffle. That part holds up to ``head_entries`` pieces of at most ``SHORT`` bytes,
    and of the ``HEAD_LONG`` first ones also those up to ``LONG`` bytes, so frequent rules and urls are
    in it and its size is bounded. The pieces it misses are looked up by a join and put back into
    their rows, which carry numbers of their own; ids come out the same however large the part is.
    """

    def __init__(self, dictionary: DataFrame, *, pattern: str = WORDS, special: dict[str, int] | None = None,
                 unk_id: int | None = None, head_entries: int = HEAD_ENTRIES):
        self.pattern = pattern
        self.special = special or {}
        self.unk_id = unk_id
        dictionary = dictionary.select("token", F.col("id").cast("long").alias("id"))
        self._split(dictionary, head_entries)

    def _split(self, dictionary: DataFrame, head_entries: int) -> None:
        entries, first, longest = dictionary.agg(
            F.count("*"), F.min("id"), F.max(F.octet_length("token"))).first()
        self.tail = None
        head = dictionary
        if entries > head_entries or (longest or 0) > SHORT:
            # Ids are unique, so a range of them bounds the rows. No sort is needed to find the head.
            place, size = F.col("id") - first, F.octet_length("token")
            in_head = ((place < head_entries) & (size <= SHORT)) | \
                ((place < min(head_entries, HEAD_LONG)) & (size <= LONG))
            head = dictionary.where(in_head)
            self.tail = dictionary.where(~in_head)
        table = head.toArrow()
        tokens = table["token"].combine_chunks()
        ids = table["id"].combine_chunks().cast(pa.int32())
        if self.special:
            tokens = pa.concat_arrays([tokens, pa.array(list(self.special), tokens.type)])
            ids = pa.concat_arrays([ids, pa.array(list(self.special.values()), ids.type)])
        self._shared = dictionary.sparkSession.sparkContext.broadcast((tokens, ids))

    def lengths(self, text: Column) -> Column:
        """Number of tokens of a text, without looking any of them up."""
        return F.size(self.pieces(text))

    def pieces(self, text: Column) -> Column:
        return _pieces(text, self.pattern, list(self.special) or None)

    def encode(self, df: DataFrame, text_column: str = "text", out: str = "ids") -> DataFrame:
        text_batches(df.sparkSession)
        if self.tail is None:
            return self._encode_in_place(df, text_column, out)
        return self._encode_with_tail(df, text_column, out)

    def _encode_in_place(self, df: DataFrame, text_column: str, out: str) -> DataFrame:
        shared, unk_id = self._shared, self.unk_id

        @F.arrow_udf(IDS)
        def lookup(found: pa.Array) -> pa.Array:
            return kernels.lookup_ids(found, *shared.value, unk_id, True)

        # Keeps filters on the ids above the lookup; pushed below, they would run it twice.
        return df.withColumn(out, lookup.asNondeterministic()(self.pieces(F.col(text_column))))

    def _encode_with_tail(self, df: DataFrame, text_column: str, out: str) -> DataFrame:
        shared = self._shared

        @F.arrow_udf(KNOWN)
        def lookup(found: pa.Array) -> pa.Array:
            return kernels.lookup_known(found, *shared.value)

        looked_up = df.withColumn("_found", lookup.asNondeterministic()(self.pieces(F.col(text_column))))
        # The number is stored with the row, so that it stays what it was whatever is computed again.
        known = stage(
            looked_up.select(*df.columns, F.col("_found.ids").alias("_ids"), F.col("_found.missing").alias("_missing"),
                             F.monotonically_increasing_id().alias("_number")),
            "looked-up",
        )
        missing = known.select("_number", F.posexplode("_missing").alias("_pos", "token"))
        resolved = missing.join(self.tail, "token", "left")
        if self.unk_id is None:
            absent = F.raise_error(F.concat(F.lit("the token dictionary lacks the piece "), "token"))
        else:
            absent = F.lit(self.unk_id)
        tail_id = F.coalesce("id", absent.cast("long"))
        patches = (
            resolved.select("_number", "_pos", tail_id.alias("_id")).repartition("_number")
            .groupBy("_number")
            .agg(F.sort_array(F.collect_list(F.struct("_pos", "_id"))).alias("_found"))
            .select("_number", F.col("_found._id").cast(IDS).alias("_tail"))
        )

        @F.arrow_udf(IDS)
        def merge(ids: pa.Array, tail: pa.Array) -> pa.Array:
            return kernels.fill_missing(ids, tail)

        none = F.array().cast(IDS)
        return (
            known.drop("_missing").join(patches, "_number", "left")
            .withColumn(out, merge("_ids", F.coalesce("_tail", none)))
            .drop("_ids", "_tail", "_number")
        )


class FunctionEncoder:
    """Encoder around a caller's tokenizer.

    ``load`` is called in the task and returns ``list[str] -> list[list[int]]``. Pieces of the
    pre-tokenization are independent of each other, so each distinct piece of an Arrow batch is
    tokenized once. Texts stay where they are: no shuffle, whatever pieces are frequent.
    """

    def __init__(self, load, *, pattern: str = PRETOKENS):
        self.load = load
        self.pattern = pattern

    def encode(self, df: DataFrame, text_column: str = "text", out: str = "ids") -> DataFrame:
        text_batches(df.sparkSession)
        load = self.load

        @F.arrow_udf(IDS)
        def tokenize(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            run = load()
            for found in batches:
                yield kernels.tokenize_pieces(found, run)

        return df.withColumn(
            out, tokenize.asNondeterministic()(pieces(F.col(text_column), self.pattern)))


def append_end(df: DataFrame, eos_id: int | None, column: str = "ids") -> DataFrame:
    """Drop rows without tokens and append the end id to the others."""
    if eos_id is None:
        raise ValueError("eos_id is required")
    return (
        df.where(F.size(column) > 0)
        .withColumn(column, F.concat(F.col(column), F.array(F.lit(eos_id))))
    )


def truncate(df: DataFrame, max_len: int, column: str = "ids") -> DataFrame:
    return df.withColumn(column, F.slice(column, 1, max_len))


def chat_special_ids() -> dict[str, int]:
    """Special tokens that chat prompts are cut at."""
    return special_ids()


def count_special(df: DataFrame, text_column: str, table: DataFrame) -> DataFrame:
    """The special-token table with ``n``, the occurrences of each token in the texts."""
    names = list(special_ids())
    found = df.select(F.explode(pieces_with_special(F.col(text_column), names)).alias("content"))
    counts = found.where(F.col("content").isin(names)).groupBy("content").agg(F.count("*").alias("n"))
    return (
        table.join(F.broadcast(counts), "content", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    )
