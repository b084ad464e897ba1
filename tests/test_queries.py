"""Every registered query runs; those with SQL give the same rows as DuckDB."""

from __future__ import annotations

import pytest

from lorespan.plans import load
from tests.compare import compare, duck

ENTRIES = load()


@pytest.fixture(scope="module")
def con(root):
    return duck(root)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, con, root, name):
    ok, note = compare(spark, con, name, ENTRIES[name], root)
    assert ok, note


def test_inventory_is_covered():
    rows = {r for e in ENTRIES.values() for r in e.rows}
    assert rows >= set(range(1, 322)) - UNIT_ONLY, sorted(set(range(1, 322)) - UNIT_ONLY - rows)


# Rows whose feature has no query of its own are tested in the other test modules.
UNIT_ONLY: set[int] = set()
