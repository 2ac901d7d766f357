"""N-gram Jaccard join with vertical partitioning.

Word shingles have one global order, rare ones first. Documents with equal shingle sets form a class;
classes are the nodes of the join.

1. A count sketch of fixed size gives rough frequencies. Shingles within the prefix of that order tell
   which classes share any rare shingle at all; the others link with nothing.
2. The shingles of those classes are counted exactly. A shingle of one class alone can't take part in
   an overlap, so it is dropped, and a class left with too few drops out.
3. Prefixes of the remaining sets, now in order of exact frequency, propose pairs. The order is cut into
   fragments; each fragment counts the overlap of a pair's segments on its own, and the partial counts
   are summed per pair.

Proposals come in three steps. First every prefix bucket proposes its most central class against the
others, then its smallest; links found so far are contracted. At last buckets that still span several
components propose their remaining pairs across components. A group of thousands of near copies is so
joined by about as many pairs as it has members, and no pair that the first steps left open is lost.

Classes are told apart by 64-bit digests of their sets, shingles by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm import byte_words as bw
from tokenloom.llm import fixed_filter
from tokenloom.llm.components import checkpointed, components, owned, row_reference, text_batches

SKETCH_CELLS = 1 << 18
SKETCH_BLOCK = 1 << 12
FRAGMENT_BITS = 2
#: Shingles are looked up one part of the hash range after another, so that files of one part alone are held at a time.
SLICES = 2
HOT_CLASS, SALTS, MEETING = 3, 64, 12


def shingle_sketch(rows: DataFrame, n: int) -> np.ndarray:
    """Occurrence counts of shingle hashes in a fixed number of cells (1 MB whatever the corpus)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SKETCH_CELLS, np.int64)
        for batch in batches:
            for _, data, offsets in bw.slices(batch.column(1)):
                found = [s for s in bw.word_shingles(data, offsets, n) if len(s)]
                if found:
                    at = (np.concatenate(found) >> np.uint64(46)).astype(np.int64)
                    cells += np.bincount(at, minlength=SKETCH_CELLS)
        used = np.flatnonzero(cells.reshape(-1, SKETCH_BLOCK).any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([cells[b * SKETCH_BLOCK:(b + 1) * SKETCH_BLOCK].tobytes() for b in used], pa.binary())],
            ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "counts"])

    blocks = rows.mapInArrow(run, "block int, counts binary").repartition(16, "block").mapInArrow(add, "block int, counts binary")
    cells = np.zeros(SKETCH_CELLS, np.int64)
    for block, counts in blocks.toLocalIterator():
        cells[block * SKETCH_BLOCK:(block + 1) * SKETCH_BLOCK] = np.frombuffer(counts, np.int64)
    return cells


def ranked(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Sorted places in the global order: six bits of frequency class, then the hash."""
    cell = (hashes >> np.uint64(46)).astype(np.int64)
    return np.sort((classes[cell] << np.uint64(58)) | (bw.mix(hashes) >> np.uint64(6)))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _classes(cells: np.ndarray) -> np.ndarray:
    """Frequency classes by powers of four above the sketch's usual level."""
    usual = max(float(np.median(cells)), 1.0)
    return np.clip(np.log2(np.maximum(cells, 1) / usual) / 2 + 1, 0, 31).astype(np.uint64)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
               num: int = 75, den: int = 100) -> DataFrame:
    """``id_col``, n_shingles, component_id: components of documents whose shingle sets link.

    Sets link when ``den * intersection >= num * union``. Null, empty and wordless texts have no
    shingles, link with nothing and stand alone. Rows that repeat an id are documents of their own
    and get a row each; component_id is the smallest id reached (null ids count as larger than any
    other, and a null-id row that links with nothing keeps null). Extra columns are ignored.
    """
    found = _members(docs, id_col, text_col, n, num, den)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """The rows of ``docs`` less those that a component's row of smallest id stands for.

    Rows without shingles all stay. Of rows with equal id and text in a component, one stays at most.
    Only rows that may go are moved, those a filter of the removed rows lets through.
    """
    found = _members(docs, id_col, text_col, n, num, den).where("n > 0")
    same = found.groupBy("id", "r").agg(F.count("*").alias("rows"), F.first("least").alias("least"))
    stays = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("r") == F.col("least.r"))
    acts = checkpointed(same.withColumn("stays", stays).where("not stays or rows > 1").select(F.col("id").alias("__id"), F.col("r").alias("__r"), "stays"))
    table = fixed_filter.build(acts.select(F.col("__r").alias("key")))
    marked = docs.withColumn("__ref", row_reference(F.col(id_col), F.col(text_col)))
    marked = marked.withColumn("__may", fixed_filter.may_hold(F.col("__ref"), table))
    some = marked.where("__may").join(acts.withColumnRenamed("stays", "__stays"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__ref") == F.col("__r")), "left")
    once = some.where("__stays").dropDuplicates(["__r", "__id"])
    names = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where("not __may").select(*names).unionByName(some.where("__stays is null").select(*names)).unionByName(once.select(*names))


def _members(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    """``id``, ``r``, ``n``, ``least`` (id, r) of every row: its reference, set size and component's first row."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("r", row_reference(F.col("id"), F.col("text")))
    spark = rows.sparkSession
    classes = spark.sparkContext.broadcast(_classes(shingle_sketch(rows, n)))
    kind = rows.schema["id"].dataType.simpleString()

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, data, offsets in bw.slices(batch.column(1)):
                sets = list(bw.word_shingles(data, offsets, n))
                digest = np.array([bw.sequence_hash(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(sets)), batch.column(2).slice(low, len(sets)), pa.array(digest), pa.array([len(s) for s in sets], pa.int64())],
                    ["id", "r", "d", "n"])

    def postings(part: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order, seen = classes.value, set()
            for batch in batches:
                for _, data, offsets in bw.slices(batch.column(1)):
                    tokens, owner, place = [], [], []
                    for s in bw.word_shingles(data, offsets, n):
                        digest = bw.sequence_hash(s)
                        if not len(s) or digest in seen:  # copies in one task bring the same postings
                            continue
                        seen.add(digest)
                        prefix = ranked(s, order)[:prefix_length(len(s), num, den)]
                        at = np.flatnonzero(prefix % np.uint64(SLICES) == part)
                        tokens.append(prefix[at])
                        owner.append(np.full(len(at), digest))
                        place.append((len(s) << 32) + at)
                    if tokens:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owner).view(np.int64)), pa.array(np.concatenate(place))],
                            ["token", "d", "np"])

        return run

    members = checkpointed(rows.mapInArrow(profile, f"id {kind}, r long, d long, n long"))
    # Of each class the row with the smallest id stands for it.
    first = F.min(F.struct(F.col("id").isNull(), "id", "r"))
    some = members.where("n > 0").groupBy("d", "n").agg(first.alias("s")).select("d", "n", F.col("s.id").alias("rep"), F.col("s.r").alias("r"))
    some = checkpointed(some)
    node = F.struct("d", "n")
    reduced = _reduced(rows, _candidates(rows, some, postings, num, den), classes, n, num, den)
    keep = F.col("m") - F.ceil(F.col("n") * num / den) + 1
    shared = reduced.select("d", "n", "m", F.posexplode(F.slice("keys", F.lit(1), keep.cast("int"))).alias("p", "token"))
    shared, forget_shared = owned(shared)

    links: DataFrame | None = None
    tried: DataFrame | None = None
    roots: DataFrame | None = None
    for step in ("central", "low", "rest"):
        pairs = _proposed(shared, roots, step, num, den)
        pairs = checkpointed(pairs if tried is None else pairs.join(tried, ["xd", "xn", "yd", "yn"], "left_anti"))
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = _linked(reduced, pairs, num, den).select(
            F.struct(F.col("xd").alias("d"), F.col("xn").alias("n")).alias("a"),
            F.struct(F.col("yd").alias("d"), F.col("yn").alias("n")).alias("b"))
        found = checkpointed(found, free=True)
        links = found if links is None else links.unionByName(found)
        roots = checkpointed(components(links))
    forget_shared()
    if roots is None:
        roots = some.select(node.alias("node"), node.alias("root")).limit(0)

    stand = F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("id"), "r")
    stands = some.select("d", "n", stand.alias("stand"), node.alias("node")).join(roots, "node", "left")
    stands = checkpointed(stands.select("d", "n", "stand", F.coalesce("root", "node").alias("root")))
    least = stands.groupBy("root").agg(F.min("stand").alias("least"))
    least = stands.join(least, "root").select("d", "n", F.struct("least.id", "least.r").alias("least"))
    lone = members.where("n = 0").select("id", "r", "n", F.struct("id", "r").alias("least"))
    return members.where("n > 0").join(least, ["d", "n"]).select("id", "r", "n", "least").unionByName(lone)


def _salted(hot: Column) -> Column:
    """Where a frequent shingle's rows go: apart by class, as nothing has to be counted over all of them."""
    return F.when(hot, F.pmod(F.xxhash64("d"), F.lit(SALTS))).otherwise(0).cast("byte")


def _candidates(rows: DataFrame, some: DataFrame, postings, num: int, den: int) -> DataFrame:
    """``some`` less the classes that, by their prefixes, can link with no other class.

    Classes that share a prefix shingle meet by size, each in its own band and the next, bands as wide as
    sizes may differ. In a small meeting every pair is tried for the overlap that places leave possible;
    in a larger one a class stays if the best of the others' bounds would do. A class with a
    frequent shingle in its prefix stays without a look at the others.
    """
    hot = F.shiftrightunsigned("token", 58) >= HOT_CLASS
    bucket = Window.partitionBy("token", "salt")

    def shared_part(part: int) -> DataFrame:
        entries = rows.mapInArrow(postings(part), "token long, d long, np long").withColumn("salt", _salted(hot))
        placed = entries.repartition("token", "salt").withColumns({"low": F.min("d").over(bucket), "high": F.max("d").over(bucket)})
        return placed.where((F.col("low") != F.col("high")) | hot).select(
            "token", "d", F.shiftright("np", 32).alias("n"), F.col("np").bitwiseAND((1 << 32) - 1).alias("p")).distinct()

    shared, forget_shared = _in_parts(shared_part)
    band = F.floor(F.log(F.col("n") + 0.0) / float(np.log(den / num)))
    met = shared.where(~hot).select("token", "d", "n", "p", F.explode(F.array(band, band + 1)).alias("band"))
    share = num / (den + num)
    spare = F.col("n") - F.col("p") - F.lit(share) * F.col("n")
    groups = met.groupBy("token", "band").agg(F.count("*").alias("size"), F.min("n").alias("least"), F.max(spare).alias("spare")).where("size > 1")
    met, forget_met = owned(met.join(groups, ["token", "band"]))
    slack = 1e-6
    large = met.where((F.col("size") > MEETING) & (F.col("spare") >= share * F.col("n") - slack)
                      & (F.col("n") - F.col("p") >= share * (F.col("n") + F.col("least")) - slack)).select("d")
    small = met.where(F.col("size") <= MEETING).select("token", "band", "d", "n", "p")
    x, y = small.alias("x"), small.alias("y")
    most = F.least(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p"))
    may = (den + num) * most >= num * (F.col("x.n") + F.col("y.n"))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.d") < F.col("y.d")) & may)
    pairs = pairs.select(F.explode(F.array("x.d", "y.d")).alias("d"))
    wanted = large.unionByName(pairs).unionByName(shared.where(hot).select("d")).distinct()
    out = checkpointed(some.join(wanted, "d").select("d", "n", "r"), free=True)
    forget_shared()
    forget_met()
    return out


def _in_parts(of: Callable[[int], DataFrame]) -> tuple[DataFrame, Callable[[], None]]:
    """The tables of all parts of the hash range together, each written before the next begins; and what deletes them."""
    tables, forget = [], []
    for part in range(SLICES):
        table, one = owned(of(part), free=True)
        tables.append(table)
        forget.append(one)
    return reduce(DataFrame.unionByName, tables), lambda: [one() for one in forget] and None


def _reduced(rows: DataFrame, classes: DataFrame, frequency, n: int, num: int, den: int) -> DataFrame:
    """``d``, ``n``, ``m``, ``keys``: of each class its shingles that other classes have too, rare ones first.

    A key is six bits of frequency, then the hash. Rare shingles are counted exactly, and those of one
    class dropped; shingles the sketch shows as frequent stay uncounted, above all others in the
    order. Classes too small to link are left out.
    """
    table = fixed_filter.build(classes.select(F.col("r").alias("key")))

    def tokens(part: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, data, offsets in bw.slices(batch.column(0)):
                    sets = [s for s in bw.word_shingles(data, offsets, n) if len(s)]
                    if sets:
                        digest = np.array([bw.sequence_hash(s) for s in sets], np.uint64).view(np.int64)
                        found = np.concatenate(sets)
                        owner = np.repeat(digest, [len(s) for s in sets])
                        mine = (found >> np.uint64(6)) % np.uint64(SLICES) == part
                        found, owner = found[mine], owner[mine]
                        rank = frequency.value[(found >> np.uint64(46)).astype(np.int64)]
                        found = ((found >> np.uint64(6)) << np.uint64(6)) | rank  # the class takes the hash's last bits
                        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(owner)], ["token", "d"])

        return run

    known = rows.where(fixed_filter.may_hold(F.col("r"), table)).select("text")
    frequent = F.col("token").bitwiseAND(63)
    hot = frequent >= HOT_CLASS
    rank = F.when(hot, F.least(F.lit(31), frequent + 20)).otherwise(F.least(F.lit(20), F.floor(F.log2("count"))))
    key = F.shiftleft(rank.cast("long"), 58).bitwiseOR(F.shiftrightunsigned("token", 6))

    def counted_part(part: int) -> DataFrame:
        held = known.mapInArrow(tokens(part), "token long, d long").withColumn("salt", _salted(hot)).repartition("token", "salt")
        counted = held.withColumn("count", F.count("*").over(Window.partitionBy("token", "salt"))).where((F.col("count") > 1) | hot)
        return counted.select("d", key.alias("key"))

    counted, forget = _in_parts(counted_part)
    lists = counted.groupBy("d").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    whole = lists.join(classes.select("d", "n"), "d").select("d", "n", F.size("keys").alias("m"), "keys")
    out = checkpointed(whole.where(den * F.col("m") >= num * F.col("n")), free=True)
    forget()
    return out


def _proposed(shared: DataFrame, roots: DataFrame | None, step: str, num: int, den: int) -> DataFrame:
    """Pairs (xd, xn, yd, yn) of classes in different components that a bucket brings together.

    ``central`` pairs every class with the one that shares most of its set with others, as the origin of near
    copies does, ``low`` with the class of smallest root, ``rest`` all classes of the bucket.
    """
    placed = shared.withColumn("root", F.struct("d", "n"))
    if roots is not None:
        placed = placed.withColumnRenamed("root", "node").join(roots, "node", "left")
        placed = placed.select("token", "d", "n", "m", "p", F.coalesce("root", "node").alias("root"))
    item = F.struct("root", "d", "n", "m", "p")
    central = F.max(F.struct((F.col("m") / F.col("n")).alias("share"), "root", "d", "n", "m", "p"))
    ends = placed.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), central.alias("central"), F.min(item).alias("low"))
    placed = placed.join(ends.where("r0 <> r1"), "token")
    if step == "rest":
        both = placed.select("token", item.alias("x")).join(placed.select("token", item.alias("y")), "token")
    else:
        both = placed.select(F.col(step).alias("x"), item.alias("y"))
    # the pair's first shared key leaves at most this overlap
    most = F.least(F.col("x.m") - F.col("x.p"), F.col("y.m") - F.col("y.p"))
    near = (den + num) * most >= num * (F.col("x.n") + F.col("y.n"))
    both = both.where((F.col("x.root") < F.col("y.root") if step == "rest" else F.col("x.root") != F.col("y.root")) & near)
    swap = F.struct("y.d", "y.n") < F.struct("x.d", "x.n")
    names = [("xd", "x.d", "y.d"), ("xn", "x.n", "y.n"), ("yd", "y.d", "x.d"), ("yn", "y.n", "x.n")]
    return both.select(*[F.when(swap, F.col(b)).otherwise(F.col(a)).alias(name) for name, a, b in names]).distinct()


def _linked(reduced: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of the proposed pairs (xd, xn, yd, yn) those that link, by summed partial overlaps."""
    asked = pairs.select(F.col("xd").alias("d")).unionByName(pairs.select(F.col("yd").alias("d"))).distinct()
    cut = lambda k: F.shiftrightunsigned(k, 58 - FRAGMENT_BITS)
    pieces = F.transform(F.array_distinct(F.transform("keys", cut)), lambda f: F.struct(
        f.alias("f"), F.filter("keys", lambda k: cut(k) == f).alias("keys")))
    # Both sides of the pairs read the segments from one shuffle.
    seg = reduced.join(asked, "d").select("d", F.explode(pieces).alias("s")).select("d", "s.f", "s.keys").repartition("d")
    half = pairs.join(seg.select(F.col("d").alias("yd"), F.col("f").alias("yf"), F.col("keys").alias("yk")), "yd")
    both = half.join(seg.select(F.col("d").alias("xd"), F.col("f").alias("xf"), F.col("keys").alias("xk")), "xd").where("xf = yf")
    partial = both.select("xd", "xn", "yd", "yn", F.size(F.array_intersect("xk", "yk")).cast("long").alias("o"))
    total = partial.groupBy("xd", "xn", "yd", "yn").agg(F.sum("o").alias("o"))
    return total.where(den * F.col("o") >= num * (F.col("xn") + F.col("yn") - F.col("o"))).select("xd", "xn", "yd", "yn")
