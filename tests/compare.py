"""Side-by-side run of a registered query and its SQL counterpart."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def rows_of(table: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = [tuple(_show(row[i]) for i in order) for row in table]
    return sorted(shown, key=repr)


def _show(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def compare(spark, con, query, sql: str, sf: str) -> tuple[int, list[str]]:
    """Row count and a list of differences (empty when equal)."""
    df = query(spark, sf)
    mine = rows_of([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(result.fetchall(), names)
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    kinds = {d[0]: str(d[1]) for d in result.description}
    for field in df.schema.fields:
        expected = _KINDS.get(field.dataType.simpleString())
        if field.name in kinds and kinds[field.name] not in expected:
            problems.append(f"type of {field.name}: {field.dataType.simpleString()} / {kinds[field.name]}")
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} != {len(theirs)}")
    if mine != theirs:
        at = next((i for i, (a, b) in enumerate(zip(mine, theirs)) if a != b), None)
        if at is not None:
            problems.append(f"row {at}: {mine[at]} != {theirs[at]}")
    return len(mine), problems


_KINDS = {
    "bigint": ("BIGINT", "NUMBER"), "int": ("INTEGER", "NUMBER"), "string": ("VARCHAR", "STRING"),
    "boolean": ("BOOLEAN", "bool"), "double": ("DOUBLE", "NUMBER"),
}
