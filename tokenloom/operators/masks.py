"""Block-diagonal causal attention masks, kept linear in the sample length.

Position i sees position j when j <= i, both are valid, and both lie in the same segment. A
segment's mask is therefore given by the list of its valid positions, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.arrays import let, numbers

NO_SEGMENT = -1


def _valid(position_ids: Column, attention_mask: Column | None) -> Column:
    if attention_mask is None:
        return F.transform(position_ids, lambda p: p >= 0)
    return F.zip_with(position_ids, attention_mask, lambda p, a: (p >= 0) & (a != 0))


def _starts(position_ids: Column, valid: Column) -> Column:
    """Indexes at which a segment begins."""
    marks = F.zip_with(position_ids, valid, lambda p, v: (p == 0) & v)
    indexed = F.transform(marks, lambda m, i: F.when(m, i))
    return F.array_compact(indexed)


def segment_index(position_ids: Column, attention_mask: Column | None = None) -> Column:
    """Segment number of every position; -1 where invalid or before the first start."""
    return let(_valid(position_ids, attention_mask), lambda valid: let(
        _starts(position_ids, valid), lambda starts: F.zip_with(
            _spread(starts, F.size(position_ids)), valid,
            lambda s, v: F.when(v, s).otherwise(NO_SEGMENT))))


def _spread(starts: Column, n: Column) -> Column:
    """Segment numbers from start indexes, without looking at validity."""
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n))
    lead = F.coalesce(F.get(starts, F.lit(0)), n)
    runs = F.zip_with(starts, ends, lambda s, e: e - s)
    # An empty ``starts`` still meets one end, giving a null run; it spreads over nothing.
    return F.concat(
        F.array_repeat(F.lit(NO_SEGMENT), lead),
        F.flatten(F.transform(runs, lambda r, k: F.array_repeat(k, F.coalesce(r, F.lit(0))))),
    )


def mask_segments(samples: DataFrame, sample: list[str]) -> DataFrame:
    """One row per segment: ``segment`` and ``keys``, its valid positions in order.

    Valid positions before the first start form segment -1 and see each other.
    """
    attention = F.col("attention_mask") if "attention_mask" in samples.columns else None
    positions = F.col("position_ids")

    def groups(valid: Column) -> Column:
        def cut(bounds: Column) -> Column:
            return F.transform(bounds, lambda b: F.struct(
                b["segment"].alias("segment"),
                F.filter(F.when(b["end"] > b["start"], F.sequence(b["start"], b["end"] - 1))
                         .otherwise(F.array().cast("array<int>")),
                         lambda i: F.get(valid, i)).alias("keys"),
            ))
        return let(_bounds(_starts(positions, valid), F.size(positions)), cut)

    found = let(_valid(positions, attention), groups)
    return (
        samples.select(*sample, F.explode(found).alias("_g"))
        .select(*sample, F.col("_g.segment").alias("segment"), F.col("_g.keys").alias("keys"))
        .where(F.size("keys") > 0)
    )


def _bounds(starts: Column, n: Column) -> Column:
    """Segments as (segment, start, end), with the stretch before the first start as -1."""
    edges = F.concat(F.array(F.lit(0)), starts)
    ends = F.concat(starts, F.array(n))
    return F.transform(F.zip_with(edges, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))),
                       lambda b, k: F.struct((k + NO_SEGMENT).alias("segment"),
                                             b["s"].alias("start"), b["e"].alias("end")))


def mask_rows(segments: DataFrame, sample: list[str]) -> DataFrame:
    """One row per query position: it sees the first ``visible`` keys of its segment."""
    return (
        segments.select(*sample, "segment", F.col("keys")[0].alias("first_key"),
                        F.posexplode("keys").alias("_rank", "position"))
        .select(*sample, "segment", "position", "first_key",
                (F.col("_rank") + 1).alias("visible"))
    )


def mask_totals(segments: DataFrame, sample: list[str]) -> DataFrame:
    """Per segment: valid positions, first key, visible pairs, and the sum of position times keys seen.

    Counted on the segments' lists; no row per position is made.
    """
    n = F.size("keys").cast("long")
    weighted = F.transform("keys", lambda position, rank: position.cast("long") * (rank + 1))
    return segments.select(
        *sample, F.col("segment").cast("long").alias("segment"), n.alias("n_positions"),
        F.col("keys")[0].cast("long").alias("first_key"), (n * (n + 1) / 2).cast("long").alias("pairs"),
        F.aggregate(weighted, F.lit(0).cast("long"), lambda total, x: total + x).alias("checksum"))


def dense_mask(samples: DataFrame, out: str = "mask") -> DataFrame:
    """The mask as a boolean matrix per sample: quadratic in the sample length, for consumers
    that need the tensor itself."""
    attention = F.col("attention_mask") if "attention_mask" in samples.columns else None
    positions = F.col("position_ids")

    def matrix(s: Column) -> Column:
        return F.transform(s["seg"], lambda a, i: F.zip_with(
            s["seg"], s["at"],
            lambda b, j: (j <= i) & (a == b) & F.get(s["ok"], i) & F.get(s["ok"], j)))

    state = F.struct(
        segment_index(positions, attention).alias("seg"),
        _valid(positions, attention).alias("ok"),
        numbers(F.size(positions)).alias("at"),
    )
    return samples.withColumn(out, let(state, matrix))


def mask_text(samples: DataFrame, order: list[str], max_samples: int) -> DataFrame:
    """The report's printed masks: 0/1 lines of the first ``max_samples`` samples."""
    shown = dense_mask(samples.orderBy(*order).limit(max_samples), "_mask")
    return (
        shown.select(*order, F.posexplode("_mask").alias("row", "_bits"))
        .select(*order, "row", F.array_join(
            F.transform("_bits", lambda b: F.when(b, "1").otherwise("0")), " ").alias("bits"))
    )
