"""Character operations on Arrow batches hold few texts of a batch as Python strings at a time."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa

from lorespan.functions import unicode as u


def test_values_and_nulls_across_slices():
    n = 2 * u.HELD + 7
    values = [None if i % 5 == 0 else f"é{i}&amp" for i in range(n)]
    assert u._no_marks.func(pa.array(values)).to_pylist() == [None if x is None else x.replace("é", "e") for x in values]
    assert u._entities.func(pa.array(values, pa.string())).to_pylist() == [None if x is None else x.replace("&amp", "&") for x in values]
    assert u._nfkc.func(pa.nulls(n, pa.string())).null_count == n and len(u._nfkc.func(pa.array([], pa.string()))) == 0


def test_memory_does_not_grow_with_the_batch():
    values = pa.array(["é" * 10_000] * (20 * u.HELD))
    tracemalloc.start()
    u._nfkc.func(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * u.HELD * 20_000
