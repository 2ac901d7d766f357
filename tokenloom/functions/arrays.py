"""Array expressions for token sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE_LABEL = -100
PAD_POSITION = -1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbers(count: Column) -> Column:
    """0 .. count-1; empty for count <= 0 (a bare ``sequence`` would count downwards)."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def block_count(length: Column, block_size: int, min_len: int) -> Column:
    """Number of consecutive blocks of a sequence, a short last block counted from ``min_len``."""
    full = F.floor(length / F.lit(block_size)).cast("int")
    rest = length % block_size
    return full + F.when(rest >= min_len, 1).otherwise(0)


def block_at(ids: Column, block_no: Column, block_size: int) -> Column:
    return F.slice(ids, block_no * block_size + 1, F.lit(block_size))


def pad_to(values: Column, length: Column, width: Column, fill: Column | int) -> Column:
    """First ``width`` values, then ``width - length`` times ``fill``."""
    fill = F.lit(fill) if isinstance(fill, int) else fill
    return F.concat(
        F.slice(values, F.lit(1), width),
        F.array_repeat(fill, F.greatest(width - length, F.lit(0))),
    )


def positions(lengths: Column) -> Column:
    """Position ids that restart at 0 for every unit length."""
    return F.flatten(F.transform(lengths, numbers))


def fingerprint(values: Column) -> Column:
    """md5 of the array's JSON; a compact stand-in for it in a report."""
    return F.md5(F.to_json(values))
