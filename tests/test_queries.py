"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from tessera.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, duck, compare, name):
    got = registry.QUERIES[name](spark, small)
    rows = [tuple(r) for r in got.collect()]
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name])
        compare(rows, got.columns, want.fetchall(), [c[0] for c in want.description])
    else:
        assert rows


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["query_id", "doc_id", "paper_id", "section", "score", "rank"]
    assert set(registry.QUERIES) <= set(entry_module.queries()) and set(registry.ORACLES) <= set(entry_module.oracle_sql())
