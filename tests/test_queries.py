"""Every registered query against its SQL counterpart."""

from __future__ import annotations

import pytest
from compare import compare, connect

from tokenloom.plans.oracles import SQL
from tokenloom.plans.queries import REGISTRY


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_a_counterpart():
    assert set(REGISTRY) == set(SQL)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, sf, name):
    rows, problems = compare(spark, con, REGISTRY[name], SQL[name], sf)
    assert not problems, problems
    assert rows > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "block_no", "n", "ids_md5"]
    assert set(REGISTRY) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
