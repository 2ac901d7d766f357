"""Merkle dataset manifest in a van Emde Boas layout.

Rows are leaves; 16 neighbours have one parent. Each group (a source) is a tree of its own, and the
groups' roots are the leaves of a last tree. A tree is stored as aligned subtrees of ``HEIGHT`` levels,
one table row each: 4,096 leaves and all nodes above them in one byte string, whose recursive layout
(`veb_layout`) gives every node's place by arithmetic. The roots of the subtrees are the leaves of the
next table, until one subtree is left. Siblings are read from the same rows, from the top down.

Leaves get their positions by a range sort on (group, order, leaf) and counts per partition, so a group
of any size is spread over partitions, and no task holds more than one subtree's leaves. Texts are
hashed where they are read and never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm import veb_layout as veb
from tokenloom.llm.components import checkpointed

HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 (binary) of the fields: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    shown = [c.cast("string") for c in columns]
    marked = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown]
    return F.unhex(F.sha2(F.concat(*marked).cast("binary"), 256))


@dataclass(frozen=True)
class Manifest:
    """``trees`` holds the tables of the groups' subtrees, leaves' table first; ``top`` those of the last tree.

    Columns of a table: g (group; 0 in ``top``), block (number of the subtree), total (nodes of the whole
    level), leaves, height, digest (root, hex), layout, ids (what the leaves stand for) and found
    (replaced leaf digests, hex, null where none).
    """

    trees: list[DataFrame]
    top: list[DataFrame]


def _numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` (g, id, leaf, found) with ``pos``, the place inside the group, and ``total``, the group's size."""
    order = [F.col("g").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf")]
    placed = nodes.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = checkpointed(placed.withColumn("part", F.spark_partition_id()).withColumn("place", place))
    counts = placed.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("total"))
    joined = placed.alias("p").join(counts.alias("c"), F.col("p.g").eqNullSafe(F.col("c.g")) & (F.col("p.part") == F.col("c.part")))
    return joined.select("p.g", "p.id", "p.leaf", "p.found", (F.col("place") + F.col("shift")).alias("pos"), "total")


def _subtrees(nodes: DataFrame, height: int) -> DataFrame:
    """One row per aligned subtree of ``nodes`` (g, id, leaf, found, pos, total)."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    schema = (f"g {kinds['g']}, block long, total long, leaves int, height int, digest string, layout binary, "
              f"ids array<{kinds['id']}>, found array<string>")
    width = veb.FAN ** height

    def run(key: tuple[pa.Scalar, pa.Scalar], table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        total = table.column("total")[0].as_py()
        levels = veb.height_of(total, height)
        layout = veb.lay_out(b"".join(table.column("leaf").to_pylist()), levels)
        one = lambda column: pa.array([column.to_pylist()], pa.list_(column.type))
        return pa.table({
            "g": pa.array([key[0].as_py()], key[0].type), "block": pa.array([key[1].as_py()], pa.int64()), "total": pa.array([total], pa.int64()),
            "leaves": pa.array([len(table)], pa.int32()), "height": pa.array([levels], pa.int32()),
            "digest": [layout[:veb.DIGEST].hex()], "layout": [layout], "ids": one(table.column("id")), "found": one(table.column("found"))})

    blocks = nodes.withColumn("block", F.floor(F.col("pos") / width).cast("long"))
    return checkpointed(blocks.groupBy("g", "block").applyInArrow(run, schema))


def _levels(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Tables of subtrees, from the leaves up, until every group has one root."""
    width = veb.FAN ** height
    tables = [_subtrees(nodes, height)]
    most = tables[0].agg(F.max("total")).first()[0] or 0
    while most > width:
        most = -(-most // width)
        roots = tables[-1].where(F.col("total") > width).select(
            "g", F.col("block").alias("id"), F.unhex("digest").alias("leaf"), F.lit(None).cast("string").alias("found"),
            F.col("block").alias("pos"), F.ceil(F.col("total") / width).cast("long").alias("total"))
        tables.append(_subtrees(roots, height))
    return tables


def build_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id",
                   height: int = HEIGHT, changes: Mapping[str, Column] | None = None, changed: Column | None = None) -> Manifest:
    """The hash trees of ``docs``, stored as tables of subtrees in the shared checkpoint folder.

    A group's leaves ascend by ``order`` (null first; rows with equal keys by leaf digest, so the tree
    doesn't depend on their order in the table). Null is a group of its own, the first. Every row is a leaf,
    repeated ones too. Nulls in any field have a digest of their own, and an empty table gives empty tables. Other
    columns are ignored.

    ``changes`` are fields as found later, say in a copy to be audited, for rows where ``changed`` holds;
    their digests are kept beside the leaves and don't enter the trees.
    """
    now = leaf_digest([F.col(c) for c in fields])
    found = F.lit(None).cast("string")
    if changes:
        later = F.lower(F.hex(leaf_digest([changes.get(c, F.col(c)) for c in fields])))
        found = F.when(F.lit(True) if changed is None else changed, later)
    nodes = docs.select(F.col(group).cast("string").alias("g"), F.col(order).alias("id"), now.alias("leaf"), found.alias("found"))
    trees = _levels(_numbered(checkpointed(nodes)), height)  # the range sort reads its input twice, texts only once
    width = veb.FAN ** height
    tops = [t.where(F.col("total") <= width).select("g", "digest") for t in trees]
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionByName(t)
    roots = roots.select(F.lit(0).alias("g"), F.col("g").alias("id"), F.unhex("digest").alias("leaf"), F.lit(None).cast("string").alias("found"))
    return Manifest(trees, _levels(_numbered(roots), height))


def _children(blocks: DataFrame) -> DataFrame:
    """Per leaf of ``blocks`` (with left, right, subroot, root): g, pos, id, digest and siblings up to the last root."""
    kinds = {f.name: f.dataType for f in blocks.schema.fields}
    schema = (f"g {kinds['g'].simpleString()}, pos long, id {kinds['ids'].elementType.simpleString()}, digest string, "
              "left array<string>, right array<string>, subroot string, root string")
    names = ["g", "block", "leaves", "height", "width", "layout", "ids", "left", "right", "subroot", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                g, block, leaves, height, width, layout, ids, left, right, subroot, root = (batch.column(k)[i].as_py() for k in range(len(names)))
                levels = veb.runs(layout, height, leaves)
                own = levels[0] if levels else [layout.hex()]
                paths = [veb.siblings(levels, k) for k in range(leaves)]
                size = 2 * veb.DIGEST
                columns = [[g] * leaves, [block * width + k for k in range(leaves)], ids,
                           [own[k // veb.FAN][k % veb.FAN * size:][:size] for k in range(leaves)],
                           [a + left for a, _ in paths], [b + right for _, b in paths], [subroot] * leaves, [root] * leaves]
                kinds = [batch.column(0).type, pa.int64(), batch.column(6).type.value_type, pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                                 ["g", "pos", "id", "digest", "left", "right", "subroot", "root"])

    return checkpointed(blocks.select(*names).mapInArrow(run, schema))


def _down(tables: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The leaves' table with siblings above each subtree. ``tops`` (g, left, right, subroot, root) are those of the trees' roots."""
    width = veb.FAN ** height
    above: DataFrame | None = None
    for table in reversed(tables):
        known = tops.withColumn("block", F.lit(0).cast("long"))
        known = known.select("g", "block", "left", "right", "subroot", "root")
        single = table.where(F.col("total") <= width).alias("t").join(known.alias("k"), F.col("t.g").eqNullSafe(F.col("k.g")))
        joined = single.select("t.*", "k.left", "k.right", "k.subroot", "k.root")
        if above is not None:
            inner = table.where(F.col("total") > width).alias("t").join(above.alias("k"), F.col("t.g").eqNullSafe(F.col("k.g")) & (F.col("t.block") == F.col("k.pos")))
            joined = joined.unionByName(inner.select("t.*", "k.left", "k.right", "k.subroot", "k.root"))
        joined = joined.withColumn("width", F.lit(width).cast("long"))
        if table is not tables[0]:
            above = _children(joined)
    return joined


def audit(manifest: Manifest, id_col: str = "doc_id", height: int = HEIGHT) -> DataFrame:
    """``id_col``, leaf, subroot, root, proof_sha256, folded_root, verified for every leaf.

    ``proof_sha256`` is the hash of all siblings on the way to the root, left to right, the leaves' level
    first. ``folded_root`` is what the digest found (the replaced one, else the leaf's) leads to with them.
    """
    # of the last tree the only root is the dataset's
    root = manifest.top[-1].where(F.col("total") <= veb.FAN ** height).select(
        "g", F.array().cast("array<string>").alias("left"), F.array().cast("array<string>").alias("right"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    sources = _children(_down(manifest.top, root, height))
    tops = sources.select(F.col("id").alias("g"), "left", "right", F.col("digest").alias("subroot"), "root")
    blocks = _down(manifest.trees, tops, height)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    names = ["leaves", "height", "layout", "ids", "found", "left", "right", "subroot", "root"]
    schema = "id " + kind + ", leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                leaves, levels, layout, ids, found, left, right, subroot, root = (batch.column(k)[i].as_py() for k in range(len(names)))
                inside = veb.runs(layout, levels, leaves)
                own = inside[0] if inside else [layout.hex()]
                above = "".join(a + b for a, b in zip(left, right, strict=True)).encode()
                size = 2 * veb.DIGEST
                digests, proofs, folded = [], [], []
                for k in range(leaves):
                    digests.append(own[k // veb.FAN][k % veb.FAN * size:][:size])
                    a, b = veb.siblings(inside, k)
                    proof = hashlib.sha256("".join(x + y for x, y in zip(a, b, strict=True)).encode())
                    proof.update(above)
                    proofs.append(proof.hexdigest())
                    folded.append(veb.fold(found[k] or digests[-1], a + left, b + right))
                columns = [pa.array(ids, batch.column(3).type.value_type), *(pa.array(c, pa.string()) for c in (digests, [subroot] * leaves, [root] * leaves, proofs, folded)),
                           pa.array([x == root for x in folded], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return blocks.select(*names).mapInArrow(run, schema).withColumnRenamed("id", id_col)
