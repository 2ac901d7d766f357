"""A Bloom filter of fixed size, built by bitmap aggregates and read in the tasks.

It spares a shuffle of rows that cannot match; rows it lets through by mistake fall out in the exact
join that follows. Its 8 MB do not grow: over a corpus that fills it, every row passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 26
BUCKET_BYTES = 4096


def _places(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(FILTER_BITS)) + 1 for i in range(2)]


def build(keys: DataFrame) -> Broadcast:
    """Filter over the column ``key`` of ``keys``."""
    at = keys.select(F.explode(F.array(*_places(F.col("key")))).alias("at"))
    maps = at.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for b, bits in maps.toLocalIterator():
        table[(b - 1) * BUCKET_BYTES:b * BUCKET_BYTES] = np.frombuffer(bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table)


def may_hold(key: Column, table: Broadcast) -> Column:
    @F.arrow_udf("boolean")
    def known(a: pa.Array, b: pa.Array) -> pa.Array:
        bits, both = table.value, np.ones(len(a), bool)
        for col in (a, b):
            at = col.to_numpy(zero_copy_only=False) - 1
            both &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return pa.array(both)

    return known(*_places(key))
