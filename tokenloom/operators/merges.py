"""Byte-pair encoding by a merge table: a fixpoint of joins over the corpus's distinct pieces."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom import kernels
from tokenloom.functions.text import pieces
from tokenloom.schemas import IDS
from tokenloom.operators.encode import build_dictionary
from tokenloom.staging import stage

# Fixed value: the byte-level tokenizers' pre-tokenization pattern.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MAX_ENTRIES = 4_000_000          # of a tokenizer's dictionary or merges; more is refused
SHORT = 64                       # bytes of a piece that the joins merge
HEAD_PIECES, HEAD_BYTES = 100_000, 64
HEAD_LONG, LONG = 1_000, 4096
ROUNDS = 4                       # rounds in one job
PIECES_PER_TASK = 25_000         # a round sorts a row for every pair of symbols, which the bytes of a shuffle don't show


def byte_names() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def byte_symbols(piece: Column) -> Column:
    """One symbol for each UTF-8 byte of a piece."""
    names, code = F.lit(byte_names()), F.hex(piece)
    at = F.sequence(F.lit(1), F.octet_length(piece))
    return F.transform(at, lambda i: F.get(names, F.conv(code.substr(i * 2 - 1, F.lit(2)), 16, 10).cast("int")))


class MergeEncoder:
    """Encoder over a dictionary ``(token, id)`` and merges ``(rank, left, right)``.

    Each distinct piece of the corpus is merged once. A round joins the adjacent symbols of all open pieces
    with the merges and replaces, in each piece, every occurrence of its lowest-ranked pair; pieces
    without a pair leave. State is partitioned by piece, into as many parts as the pieces take, and merges are
    broadcast, so the rounds of one job shuffle once. Pieces above ``SHORT`` bytes, which would take a round for every
    merge, are merged inside the tasks with a queue. Ids are joined back to the texts: the most frequent
    pieces by broadcast, so that what is left to the shuffle has no hot key.

    Null texts and texts without pieces get an empty list.
    """

    def __init__(self, vocab: DataFrame, merges: DataFrame, *, pattern: str = BYTE_LEVEL,
                 head_pieces: int = HEAD_PIECES):
        for name, table in (("dictionary", vocab), ("merges", merges)):
            if table.limit(MAX_ENTRIES + 1).count() > MAX_ENTRIES:
                raise ValueError(f"the {name} of a tokenizer may have at most {MAX_ENTRIES} entries")
        self.vocab = F.broadcast(vocab.select(F.col("token").alias("symbol"), F.col("id").cast("int")))
        # Of a pair that is listed twice the first line counts.
        self.merges = merges.groupBy("left", "right").agg(F.min("rank").alias("rank"))
        self.pattern = pattern
        self.head_pieces = head_pieces

    def piece_table(self, df: DataFrame, text_column: str = "text") -> DataFrame:
        """``(token, place, ids)``: each distinct piece, its place by falling frequency, its token ids."""
        counted = stage(build_dictionary(df, text_column, self.pattern, first_id=0)
                        .select("token", F.col("id").alias("place")), "pieces")
        short = F.octet_length("token") <= SHORT
        merged = self._merge_short(counted.where(short)).unionByName(self._merge_long(counted.where(~short)))
        found = merged.select("token", "place", F.posexplode("symbols").alias("pos", "symbol"))
        absent = F.raise_error(F.concat(F.lit("the token dictionary lacks the symbol "), "symbol"))
        numbered = found.join(self.vocab, "symbol", "left").withColumn("id", F.coalesce("id", absent.cast("int")))
        pairs = F.sort_array(F.collect_list(F.struct("pos", "id")))
        return numbered.groupBy("token", "place").agg(pairs.alias("found")).select(
            "token", "place", F.col("found.id").cast(IDS).alias("ids"))

    def _merge_short(self, counted: DataFrame) -> DataFrame:
        state = counted.select("place", F.struct("token", byte_symbols(F.col("token")).alias("symbols")).alias("piece"))
        merges = F.broadcast(stage(self.merges, "merges"))
        closed, left = [], counted.count()
        while True:
            state = state.repartition(max(1, -(-left // PIECES_PER_TASK)), "place")
            for _ in range(ROUNDS):
                state = _merge_round(state, merges)
            # A piece whose last round found no pair is done.
            state = stage(state, "merge-rounds")
            closed.append(state.where(~F.col("open")).select("piece.token", "place", "piece.symbols"))
            state = state.where("open").drop("open")
            left = state.count()
            if not left:
                return reduce(DataFrame.unionByName, closed)

    def _merge_long(self, counted: DataFrame) -> DataFrame:
        table = self.merges.toArrow().combine_chunks()
        columns = [table[c].combine_chunks() for c in ("left", "right", "rank")]
        shared = counted.sparkSession.sparkContext.broadcast((*columns, byte_names()))

        @F.arrow_udf(T.ArrayType(T.StringType()))
        def merge(values: pa.Array) -> pa.Array:
            return pa.array(kernels.merge_long(values, *shared.value), type=pa.list_(pa.string()))

        return counted.select("token", "place", merge("token").alias("symbols"))

    def encode(self, df: DataFrame, text_column: str = "text", out: str = "ids") -> DataFrame:
        size, place = F.octet_length("token"), F.col("place")
        in_head = ((place < self.head_pieces) & (size <= HEAD_BYTES)) | \
            ((place < min(self.head_pieces, HEAD_LONG)) & (size <= LONG))
        # The number is stored with the row, so that it stays what it was whatever is computed again.
        rows = stage(df.withColumn("_number", F.monotonically_increasing_id()), "to-merge")
        table = stage(self.piece_table(rows, text_column), "merged")
        words = rows.select("_number", F.posexplode(pieces(F.col(text_column), self.pattern)).alias("_pos", "token"))
        near = words.join(F.broadcast(table.where(in_head).drop("place")), "token", "left")
        far = near.where(F.col("ids").isNull()).drop("ids").join(table.where(~in_head).drop("place"), "token")
        known = near.where(F.col("ids").isNotNull()).unionByName(far)
        found = F.sort_array(F.collect_list(F.struct("_pos", "ids")))
        ids = known.groupBy("_number").agg(found.alias("_found")).select(
            "_number", F.flatten("_found.ids").alias("_ids"))
        return (
            rows.join(ids, "_number", "left")
            .withColumn(out, F.coalesce("_ids", F.array().cast(IDS)))
            .drop("_number", "_ids")
        )


def _merge_round(state: DataFrame, merges: DataFrame) -> DataFrame:
    """One round: ``open`` tells pieces that had a pair to merge.

    Of a piece's pairs the first one carries the piece itself, so that what is sorted grows with the pairs alone.
    """
    symbols = F.col("piece.symbols")
    size = F.size(symbols)
    pairs = F.when(size > 1, F.array_distinct(F.zip_with(
        F.slice(symbols, 1, size - 1), F.slice(symbols, 2, size - 1),
        lambda a, b: F.struct(a.alias("left"), b.alias("right")))))
    found = state.select("place", "piece", F.posexplode_outer(pairs).alias("at", "pair"))
    carried = F.when(F.coalesce("at", F.lit(0)) == 0, F.col("piece"))
    found = found.select("place", carried.alias("piece"), "pair.left", "pair.right").join(merges, ["left", "right"], "left")
    pair = F.when(F.col("rank").isNotNull(), F.struct("rank", "left", "right"))
    told = found.select("place", "piece", pair.alias("pair")).where("piece is not null or pair is not null")
    best = told.groupBy("place").agg(F.first("piece", ignorenulls=True).alias("piece"), F.min("pair").alias("best"))
    left, right = F.col("best.left"), F.col("best.right")
    joined = F.aggregate(symbols, F.array().cast("array<string>"), lambda done, s: F.when(
        (s == right) & (F.get(done, F.size(done) - 1) == left),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(left, right))),
    ).otherwise(F.concat(done, F.array(s))))
    is_open = F.col("best").isNotNull()
    merged = F.struct(F.col("piece.token").alias("token"), F.when(is_open, joined).otherwise(symbols).alias("symbols"))
    return best.select("place", merged.alias("piece"), is_open.alias("open"))
