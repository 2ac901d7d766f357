"""Embedding near-dedup by sorted projection passes.

Equal vectors form a class. Each pass orders the classes of a label lexicographically by concatenated
random hashes (signs of projections) and compares every vector with the next ``window`` ones; verified
links of all passes are united into components. A window bounds what one pass compares, so links inside
a component are counted anew and exactly: members within half the threshold angle of the component's
centre all link with each other by the triangle inequality, and only the others are compared, in blocks.
A pass misses links across the borders of its range partitions and beyond its window; other passes,
with other hashes, find them. The first passes tell how many leading bits a pair must share to stand
within the window, which grows with the label; from the chance that a pair just at the threshold shares
them, each label gets as many further passes as an expected recall of ``RECALL`` takes. Two vectors of
a label that no pass brings together stay unlinked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.components import checkpointed, components

THRESHOLD = 0.93
PASSES, TOGETHER, BITS, WINDOW = 8, 4, 62, 48
RECALL = 0.98
BLOCK = 256
MARGIN = 1e-6


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _units(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _forest(a: list[int], b: list[int]) -> list[int]:
    """Places of the links that join two trees."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = top(x), top(y)
        if x != y:
            parent[x] = y
            kept.append(i)
    return kept


def _pass_links(classes: DataFrame, numbers: range, window: int, threshold: float) -> DataFrame:
    """Links (a, b) that spanning forests of the compared windows of these passes hold, and rows without a link.

    The latter tell per ``label`` and ``width`` of how many vectors (``n``) the one ``window`` places on shares
    ``bits`` leading bits; vectors linked with that one are left out, as their surroundings are linked anyway.
    A column ``passes`` of ``classes`` ends the passes of its row.
    """
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(1).value_lengths().to_numpy()
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                units = _units(part.column(1), width)
                for number in numbers:
                    planes = np.random.default_rng((number, width)).standard_normal((width, BITS))
                    bits = (units @ planes > 0).astype(np.int64)
                    key = bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    asked = part.column(3).to_numpy() > number
                    some, key = part.filter(pa.array(asked)), key[asked]
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0), some.column(1), some.column(2), pa.array(np.full(len(key), number, np.int32)), pa.array(np.full(len(key), width, np.int32)), pa.array(key)],
                        ["c", "unit", "label", "pass", "width", "key"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.RecordBatch | None = None
        for batch in batches:
            if tail is not None:
                batch = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
            old = tail.num_rows if tail is not None else 0
            tail = batch.slice(max(batch.num_rows - window, 0))
            group = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True))
            change = np.flatnonzero([True, *[x != y for x, y in zip(group[1:], group[:-1], strict=True)]])
            ids = batch.column(0).to_numpy()
            keys = batch.column(5).to_numpy()
            left, right = [], []
            for low, high in zip(change.tolist(), [*change[1:].tolist(), len(group)], strict=True):
                units = _units(batch.column(1).slice(low, high - low), group[low][2])
                for k in range(1, min(window, high - low - 1) + 1):
                    near = np.einsum("ij,ij->i", units[k:], units[:-k]) >= threshold
                    hit = np.flatnonzero(near)
                    if k == window:
                        far = np.flatnonzero(~near)
                        far = far[far + k + low >= old]
                        shared = BITS - np.frexp((keys[low + far] ^ keys[low + far + k]).astype(np.float64))[1]
                        bits, n = np.unique(shared, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64()), pa.array([group[low][0]] * len(n), batch.column(2).type),
                             pa.array(np.full(len(n), group[low][2], np.int32)), pa.array(bits.astype(np.int32)), pa.array(n)], names)
                    hit = hit[hit + k + low >= old]  # the tail was compared in its own batch
                    left.append(ids[low + hit])
                    right.append(ids[low + hit + k])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                kept = _forest(a.tolist(), b.tolist())
                none = len(kept)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[kept]), pa.array(b[kept]), pa.nulls(none, batch.column(2).type), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64())], names)

    label = classes.schema["label"].dataType.simpleString()
    names = ["a", "b", "label", "width", "bits", "n"]
    order = ["pass", "label", "width", "key", "c"]
    rows = classes.select("c", "unit", "label", "passes").mapInArrow(keyed, f"c long, unit array<double>, label {label}, pass int, width int, key long")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compared, f"a long, b long, label {label}, width int, bits int, n long")


def _passes(told: DataFrame, threshold: float, recall: float) -> DataFrame:
    """``label``, ``width``, ``passes``: how many passes bring an expected ``recall`` of pairs at the threshold together.

    A pair that shares one bit more than the vectors a window apart stands within the window.
    """
    sizes = told.where("a is null").groupBy("label", "width", "bits").agg(F.sum("n").alias("n"))
    sizes = sizes.groupBy("label", "width").agg(F.collect_list(F.struct("bits", "n")).alias("found"))
    same = 1 - math.acos(threshold) / math.pi

    @F.udf("int")
    def needed(found: list) -> int:
        chance = same ** (np.array([f["bits"] for f in found]) + 1.0)
        share = np.array([f["n"] for f in found]) / sum(f["n"] for f in found)
        low, high = 0, 1
        while (share * (1 - chance) ** high).sum() > 1 - recall:
            low, high = high, high * 2
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if (share * (1 - chance) ** mid).sum() > 1 - recall else (low, mid)
        return high

    return sizes.select("label", "width", needed("found").alias("passes"))


def _fringe_links(members: DataFrame, threshold: float) -> DataFrame:
    """``c``, ``more``: links between members of which one at least is no core member, in blocks."""
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum((~F.col("core")).cast("long")).alias("fringe")).where("fringe > 0")
    some = members.join(sizes, "root")
    block = lambda n: F.pmod(F.xxhash64("c"), F.ceil(F.col(n) / BLOCK))
    pack = F.collect_list(F.struct("c", "copies", "core", "unit"))
    every = some.groupBy("root", block("n").alias("at")).agg(pack.alias("members")).drop("at")
    fringe = some.where(~F.col("core")).groupBy("root", block("fringe").alias("at")).agg(pack.alias("edge")).drop("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (batch.column(k)[i].values for k in (0, 1))
                cx, cy = x.field("c").to_numpy(), y.field("c").to_numpy()
                width = len(x.field("unit")[0].values)
                near = _units(x.field("unit"), width) @ _units(y.field("unit"), width).T >= threshold
                near &= cx[:, None] != cy[None, :]
                core = y.field("core").to_numpy(zero_copy_only=False).astype(bool)
                ours = near @ y.field("copies").to_numpy()
                theirs = (near.T @ x.field("copies").to_numpy()) * core  # fringe members count from their own side
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cx, cy])), pa.array(np.concatenate([ours, theirs]).astype(np.int64))], ["c", "more"])

    pairs = fringe.join(every, "root").select("edge", "members").hint("rebalance")
    return pairs.mapInArrow(run, "c long, more long").groupBy("c").agg(F.sum("more").alias("more"))


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """``id_col``, n_links, component_id, kept: near-duplicate vectors of a label by cosine.

    Vectors link when both have the same non-null label and length and their cosine in double precision
    is at least ``threshold``; null, empty and zero vectors, and those with null or non-finite
    components, link with nothing. Every row counts, so of rows with equal vectors each links with the
    others, equal ids or not. component_id is the smallest id reached (null ids last; a null id that links
    with nothing keeps null, and is kept). Extra columns are ignored.
    """
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    base = rows.select(F.col(id_col).alias("id"), vector.alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    peak = F.array_max(F.transform("v", lambda x: F.abs(x)))
    valid = F.col("v").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite & (peak > 0)
    base = base.withColumn("valid", F.coalesce(valid, F.lit(False)))
    marks = [F.xxhash64("v"), F.hash("v")]
    base = checkpointed(base.select("id", "label", "valid", F.when(F.col("valid"), F.transform("v", lambda x: x + 0.0)).alias("v")).withColumns({"h1": marks[0], "h2": marks[1]}))
    same = ["label", "h1", "h2"]
    good = base.where("valid")
    classes = good.groupBy(*same).agg(F.count("*").alias("copies"), F.min("id").alias("rep"), F.min("v").alias("v"))
    scaled = classes.withColumn("peak", peak).withColumn("v", F.transform("v", lambda x: x / F.col("peak"))).drop("peak")
    unit = F.transform("v", lambda x: x / F.col("norm"))
    classes = scaled.withColumn("norm", F.sqrt(_dot(F.col("v"), F.col("v")))).withColumn("unit", unit).drop("v", "norm")
    classes = checkpointed(classes.withColumn("c", F.monotonically_increasing_id()))

    first = classes.withColumn("passes", F.lit(passes))
    found = [checkpointed(_pass_links(first, range(p, min(p + TOGETHER, passes)), window, threshold)) for p in range(0, passes, TOGETHER)]
    more = _passes(found[0], threshold, recall).where(F.col("passes") > passes)
    more = checkpointed(more.withColumnsRenamed({"label": "l", "width": "w"}))
    most = more.agg(F.max("passes")).first()[0] or passes
    again = classes.join(more, (F.col("label") == F.col("l")) & (F.size("unit") == F.col("w"))).drop("l", "w")
    for p in range(passes, most, TOGETHER):
        found.append(checkpointed(_pass_links(again.where(F.col("passes") > p), range(p, min(p + TOGETHER, most)), window, threshold), free=True))
    links = found[0]
    for others in found[1:]:
        links = links.unionByName(others)
    links = links.where("a is not null").select("a", "b")
    roots = components(links)

    members = checkpointed(classes.join(roots.select(F.col("node").alias("c"), "root"), "c").select("c", "root", "copies", "rep", "unit"))
    mean = members.select("root", F.posexplode("unit").alias("i", "x")).groupBy("root", "i").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    mean = mean.withColumn("length", F.sqrt(_dot(F.col("mean"), F.col("mean"))))
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), _dot(F.col("unit"), F.col("mean")) / F.col("length"))))
    core = F.coalesce(angle <= math.acos(threshold) / 2 - MARGIN, F.lit(False))
    members = checkpointed(members.join(mean, "root").select("c", "root", "copies", "rep", "unit", core.alias("core")))
    whole = members.groupBy("root").agg(F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("cores"), F.min("rep").alias("least"))
    counted = members.drop("unit").join(whole, "root").join(_fringe_links(members, threshold), "c", "left")
    own = F.when(F.col("core"), F.col("cores") - F.col("copies")).otherwise(0)
    counted = counted.select("c", (own + F.coalesce("more", F.lit(0))).alias("links"), "least")

    known = classes.select("c", *same, "copies", "rep").join(counted, "c", "left")
    known = known.select(*same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("least"))
    linked = good.join(known, same).select("id", "n_links", "least")
    alone = base.where(~F.col("valid")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("least"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", F.col("least").alias("component_id"), F.col("id").eqNullSafe(F.col("least")).alias("kept"))
