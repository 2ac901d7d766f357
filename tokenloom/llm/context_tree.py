"""LM scoring by context-tree weighting.

Training counts every (context, byte) of the corpus and every word, with partial counts in the tasks
and one shuffle. A context seen ``LEAST`` times or more is a node of the tree, at any corpus size; what
rarer ones saw is pooled in their parent's rest leaf, and no count is lost. The tree's top, contexts of
at most ``TOP`` bytes, travels by broadcast; the subtrees below it are dealt out by their root and
weighted in the tasks, which then tell the log probability of every gram that occurs in the table.

Objects go into broadcasts as bytes that carry their classes, so executors need no install.

Grams and words are looked up in two ways: the most frequent ones (at most ``HEAD_GRAMS`` grams; words
with at least ``head_share`` of all tokens) by broadcast, all others by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import byte_words as bw
from tokenloom.llm import ctw_kernel as ck
from tokenloom.llm.components import checkpointed, text_batches

DEPTH, TOP = 5, 2
LEAST = 2
HEAD_GRAMS = 1 << 21
SUBTREE_GRAMS = 100_000
HEAD_SHARE = 2.0 ** -22
HELD = 3_000_000
WORD, GRAM, TEXT, HELD_GRAM = 0, 1, 2, 3


def held_out(id_col: Column, folds: int) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(keys) else counts


def corpus_counts(rows: DataFrame, depth: int) -> DataFrame:
    """``kind``, ``key``, ``n``, ``m``: how often each word (by hash), byte gram and text end occurs in the rows
    (id, text, held_out) that are learned from; for grams, m counts all rows."""
    def emit(kind: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if parts:
            keys, counts = _merged(parts)
            for low in range(0, len(keys), 500_000):
                k, c = keys[low:low + 500_000], counts[low:low + 500_000]
                n = np.zeros_like(c) if kind == HELD_GRAM else c
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), GRAM if kind == HELD_GRAM else kind, np.int32)), pa.array(k), pa.array(n), pa.array(c)], ["kind", "key", "n", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {WORD: [], GRAM: [], HELD_GRAM: []}
        texts = 0
        for batch in batches:
            apart = batch.column(2)
            for learn, part in ((True, batch.filter(pc.invert(apart))), (False, batch.filter(apart))):
                texts += part.num_rows * learn
                for _, data, offsets in bw.slices(part.column(1)):
                    text, places, _ = ck.padded(data, offsets, depth)
                    told = [(GRAM if learn else HELD_GRAM, ck.gram_keys(text, places, depth))]
                    if learn:
                        lower = bw.LOWER[data]
                        starts, ends, _ = bw.word_spans(lower, offsets)
                        told.append((WORD, bw.word_hashes(lower, starts, ends).view(np.int64)))
                    for kind, keys in told:
                        held[kind].append(np.unique(keys, return_counts=True))
                        if sum(len(k) for k, _ in held[kind]) > HELD:
                            held[kind] = [_merged(held[kind])]
                            if len(held[kind][0][0]) > HELD // 2:
                                yield from emit(kind, held[kind])
                                held[kind] = []
        for kind, parts in held.items():
            yield from emit(kind, parts)
        yield from emit(TEXT, [(np.zeros(1, np.int64), np.full(1, texts))] if texts else [])

    counted = rows.mapInArrow(run, "kind int, key long, n long, m long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _top_counts(grams: DataFrame, top: int, least: float) -> dict[tuple[int, int], np.ndarray]:
    """256 counts of every node down to ``top`` bytes; the root is always one."""
    context = F.shiftright("key", 8).bitwiseAND((1 << 8 * top) - 1)
    table = grams.where("n > 0").groupBy(context.alias("context"), F.col("key").bitwiseAND(255).alias("byte")).agg(F.sum("n").alias("n")).toArrow()
    contexts, which = np.unique(table["context"].to_numpy(), return_inverse=True)
    counts = np.zeros((len(contexts), 256))
    counts[which, table["byte"].to_numpy()] = table["n"].to_numpy()
    nodes: dict[tuple[int, int], np.ndarray] = {}
    for d in range(top, -1, -1):
        nodes |= {(d, int(c)): row for c, row in zip(contexts, counts, strict=True) if not d or row.sum() >= least}
        contexts, which = np.unique(contexts & ((1 << 8 * max(d - 1, 0)) - 1), return_inverse=True)
        above = np.zeros((len(contexts), 256))
        np.add.at(above, which, counts)
        counts = above
    return nodes


def gram_logs(grams: DataFrame, depth: int, resolution: float | None = None) -> DataFrame:
    """``key``, ``m``, ``log``: log10 probability of each gram's byte after its context, by the tree of ``grams`` (key, n, m).

    Nodes are contexts seen ``LEAST`` times, or those with a share of ``resolution`` of all bytes if that is given.
    """
    total, distinct = grams.agg(F.sum("n"), F.count("*")).first()
    least = LEAST if resolution is None else max(1.0, (total or 0) * resolution)
    top = min(depth, TOP)
    root = F.shiftright("key", 8).bitwiseAND((1 << 8 * min(top + 1, depth)) - 1)
    dealt = grams.repartition(distinct // SUBTREE_GRAMS + 1, root)

    def subtrees(batches: Iterator[pa.RecordBatch]) -> tuple[ck.Subtrees, pa.Table] | None:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return None
        table = pa.Table.from_batches(parts)
        return ck.Subtrees(table["key"].to_numpy(), table["n"].to_numpy(), top, depth, least), table

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := subtrees(batches)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[0].sums()], ["at", "zeros", "ones", "weighted"])

    deeper = None
    if depth > top:
        told = dealt.mapInArrow(sums, "at long, zeros double, ones double, weighted double")
        told = told.groupBy("at").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted")).toArrow()
        at = told["at"].to_numpy()
        contexts, which = np.unique(at >> 8, return_inverse=True)
        dense = np.zeros((len(contexts), 3, 255))
        for i, name in enumerate(("zeros", "ones", "weighted")):
            dense[which, i, (at & 255) - 1] = told[name].to_numpy()
        deeper = {int(c): x for c, x in zip(contexts, dense, strict=True)}
    tree = grams.sparkSession.sparkContext.broadcast(cloudpickle.dumps(ck.ContextTree(_top_counts(grams, top, least), top, deeper)))

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := subtrees(batches)) is not None:
            part, table = found
            out = pa.table([table["key"], table["m"], pa.array(part.logs(cloudpickle.loads(tree.value)))], names=["key", "m", "log"])
            yield from out.to_batches(max_chunksize=100_000)

    return dealt.mapInArrow(logs, "key long, m long, log double")


def _head_least(told: DataFrame, most: int) -> int:
    """Least m that at most ``most`` rows of ``told`` reach."""
    sizes = told.groupBy(F.floor(F.log2(F.col("m").cast("double")) * 8).alias("b")).agg(F.count("*").alias("n"), F.min("m").alias("m")).collect()
    held, least = 0, np.iinfo(np.int64).max
    for r in sorted(sizes, key=lambda r: -r["b"]):
        held += r["n"]
        if held > most:
            break
        least = r["m"]
    return int(least)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10,
                depth: int = DEPTH, resolution: float | None = None, head_share: float = HEAD_SHARE,
                head_grams: int = HEAD_GRAMS) -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Rows whose id's crc32 is no multiple of ``folds`` are learned from. score is log10 of the tree's
    probability of the text's bytes and its end, bits_per_byte its code length per byte, end counted.
    Null texts are empty; their one token is the end. Without training rows every byte choice is even
    and base_score is 0. Repeated rows and null ids (held out) keep a row each; extra columns are ignored.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("id"), folds))
    counts = checkpointed(corpus_counts(rows.select("id", "text", "held_out"), depth))
    grams = checkpointed(gram_logs(counts.where(F.col("kind") == GRAM).select("key", "n", "m"), depth, resolution))
    frequent = F.col("m") >= _head_least(grams, head_grams)
    near = grams.where(frequent).select("key", "log").toArrow()
    tree = spark.sparkContext.broadcast(cloudpickle.dumps(ck.KeyTable(near["key"].to_numpy(), near["log"].to_numpy())))
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    told = words.agg(F.sum("n"), F.count("*")).first()
    ends = counts.where(F.col("kind") == TEXT).agg(F.sum("n")).first()[0] or 0
    tokens, distinct = (told[0] or 0) + ends, told[1] + (1 if ends else 0)
    is_head = F.col("n") >= F.lit(head_share * tokens)
    common = words.where(is_head).toArrow()
    order = np.argsort(common["key"].to_numpy())
    head = spark.sparkContext.broadcast((common["key"].to_numpy()[order], common["n"].to_numpy()[order].astype(np.float64)))
    floor = np.log10(tokens + 0.1 * (distinct + 1))
    end_score = float(np.log10(ends + 0.1) - floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seen = head.value
        known = cloudpickle.loads(tree.value)
        for batch in batches:
            for low, data, offsets in bw.slices(batch.column(1)):
                n = len(offsets) - 1
                lower = bw.LOWER[data]
                starts, ends_, first = bw.word_spans(lower, offsets)
                found = bw.word_hashes(lower, starts, ends_).view(np.int64)
                at = np.searchsorted(keys, found)
                hit = at < len(keys)
                hit[hit] = keys[at[hit]] == found[hit]
                logs = np.zeros(len(found))
                logs[hit] = np.log10(seen[at[hit]] + 0.1) - floor
                sums = np.append(0.0, np.cumsum(logs))
                hits = np.append(0, np.cumsum(hit))
                rare = np.append(0, np.cumsum(~hit))[first]
                text, places, bounds = ck.padded(data, offsets, depth)
                asked = ck.gram_keys(text, places, depth)
                held, given = known.find(asked)
                scores = np.append(0.0, np.cumsum(given))[bounds]
                far = np.append(0, np.cumsum(~held))[bounds]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, n), batch.column(2).slice(low, n), pa.array(np.diff(first) + 1), pa.array(np.diff(hits[first])),
                     pa.array(np.diff(sums[first])), pa.array(np.diff(scores)), pa.array(np.diff(offsets)),
                     pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.array(found[~hit])),
                     pa.ListArray.from_arrays(pa.array(far, pa.int32()), pa.array(asked[~held]))], names)

    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes", "rare", "far"]
    scored = rows.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, rare array<long>, far array<long>")
    scored = checkpointed(scored.withColumn("row", F.monotonically_increasing_id()))
    word = F.col("kind") == WORD
    asked = scored.select("row", F.lit(WORD).alias("kind"), F.explode("rare").alias("key")).unionByName(
        scored.select("row", F.lit(GRAM).alias("kind"), F.explode("far").alias("key")))
    table = words.where(~is_head).select(F.lit(WORD).alias("kind"), "key", F.col("n").cast("double").alias("value")).unionByName(
        grams.where(~frequent).select(F.lit(GRAM).alias("kind"), "key", F.col("log").alias("value")))
    looked = asked.join(table, ["kind", "key"], "left").groupBy("row").agg(
        F.count(F.when(word, F.col("value"))).alias("more"),
        F.sum(F.when(word, F.log10(F.coalesce("value", F.lit(0.0)) + 0.1) - F.lit(float(floor)))).alias("rest"),
        F.sum(F.when(~word, F.col("value"))).alias("deep"))
    both = scored.drop("rare", "far").join(looked, "row", "left")
    both = both.withColumn("score", F.col("score") + F.coalesce("deep", F.lit(0.0)))
    return both.select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(int(tokens)).alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) + F.lit(end_score)).alias("base_score"), "score", "n_bytes",
        (-F.col("score") / float(np.log10(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
