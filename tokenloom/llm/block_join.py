"""Nearest neighbours by a block matrix join.

Queries go into strips, candidates into stripes, both of bounded size; a task multiplies one strip with one
stripe in int8 tiles. Tiles bound every cosine from both sides, surviving pairs are scored from the original
vectors, and bounded heaps keep each query's best (`int8_tiles`). The heaps of all stripes meet once more
by query. Every candidate is compared with every query, so results are exact.

Of equal vectors only the ``k + 1`` smallest ids can be among anyone's ``k`` nearest; the others are left out
before vectors move, on the map side too, so a vector that many rows share costs no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm import int8_tiles
from tokenloom.llm.components import checkpointed

#: Components of one strip or stripe: 32 MB as doubles, whatever the table.
COMPONENTS = 1 << 22
#: Small tables are cut finer than that, down to this many candidates, so that all cores have tiles.
FEWEST = 2048


def _usable(vector: Column) -> Column:
    """Neither null, empty nor zero, all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _numbered(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Candidates and queries with ``width``, ``strips`` and ``stripes``."""
    equal = Window.partitionBy("vector").orderBy("id")
    candidates = checkpointed(rows.select("id", "vector").withColumn("nth", F.row_number().over(equal)).where(F.col("nth") <= k + 1)
                              .select("id", "vector", F.size("vector").alias("width")))
    queries = checkpointed(rows.where("asks").select("id", "vector", F.size("vector").alias("width")))
    cores = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = F.greatest(F.lit(1), F.floor(F.lit(COMPONENTS) / F.col("width")))
    strips = queries.groupBy("width").agg(F.count("*").alias("n")).select("width", F.ceil(F.col("n") / most).cast("int").alias("strips"))
    stripes = candidates.groupBy("width").agg(F.count("*").alias("n")).select(
        "width", F.greatest(F.ceil(F.col("n") / most), F.least(F.lit(cores), F.ceil(F.col("n") / FEWEST))).cast("int").alias("stripes"))
    grid = checkpointed(strips.join(stripes, "width"))
    return candidates.join(grid, "width"), queries.join(grid, "width")


def nearest(vectors: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, rank (from 1), ``id_col``, score: the ``k`` rows of largest cosine for every row where ``asks`` holds.

    Scores are cosines of the original vectors in double precision, summed from the first component to
    the last. Ties go to the smaller id. A row doesn't meet rows of its own id; rows equal in id and
    vector count once; rows that share an id alone are told apart and each asks for itself. Only
    vectors of equal length are compared. Rows with a null id and vectors that are null, empty, zero or hold
    null or non-finite components take no part. A query with fewer candidates gets them all, one without any
    no row. Extra columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & _usable(F.col("vector")))
    rows = checkpointed(rows.groupBy("id", "vector").agg(F.max("asks").alias("asks")))
    candidates, queries = _numbered(rows, k)
    candidates = candidates.select("width", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip"),
                                   F.pmod(F.xxhash64("id"), F.col("stripes")).cast("int").alias("stripe"), "id", "vector")
    queries = queries.select("width", F.pmod(F.xxhash64("id", F.lit(1)), F.col("strips")).cast("int").alias("strip"),
                             F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe"), "id", "vector", F.xxhash64("vector").alias("ref"))

    def tile(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        width = key[0].as_py()
        column = lambda t, name: t.column(name).combine_chunks()
        asked = int8_tiles.Rows(left.column("id").to_numpy(), int8_tiles.matrix(column(left, "vector"), width))
        found = int8_tiles.Rows(right.column("id").to_numpy(), int8_tiles.matrix(column(right, "vector"), width))
        best = int8_tiles.Nearest(len(asked.ids), k)
        int8_tiles.search(asked, found, k, best)
        q, r = np.nonzero(best.score > -np.inf)
        return pa.table({"query_id": asked.ids[q], "ref": left.column("ref").to_numpy()[q], "score": best.score[q, r], "vec_id": best.id[q, r]})

    tiles = queries.groupBy("width", "strip", "stripe").cogroup(candidates.groupBy("width", "strip", "stripe"))
    runs = tiles.applyInArrow(tile, "query_id long, ref long, score double, vec_id long")
    runs = runs.repartition("query_id", "ref").sortWithinPartitions("query_id", "ref")
    names = ["query_id", "rank", "vec_id", "score"]

    def ranked(held: list[tuple[int, int, float, int]]) -> pa.RecordBatch:
        out: list[tuple[int, int, int, float]] = []
        low = 0
        while low < len(held):
            high = low
            while high < len(held) and held[high][:2] == held[low][:2]:
                high += 1
            best = int8_tiles.merged([r[2:] for r in held[low:high]], k)
            out += [(held[low][0], at, vec_id, score) for at, (score, vec_id) in enumerate(best, 1)]
            low = high
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, float, int]] = []
        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            # the last query may go on in the next batch
            end = len(held)
            while end and held[end - 1][:2] == held[-1][:2]:
                end -= 1
            if end:
                yield ranked(held[:end])
                held = held[end:]
        if held:
            yield ranked(held)

    return runs.mapInArrow(merge, "query_id long, rank int, vec_id long, score double").withColumnRenamed("vec_id", id_col)
