"""The few character operations Spark has no expression for, as Arrow batches.

Rows that do not need the operation are passed as null, so their text never leaves the JVM.
"""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

NON_ASCII = "[^\\x00-\\x7f]"


# Texts of a batch that are Python strings at a time; the rest of it stays in Arrow.
HELD = 128


def _per_value(function):
    @F.arrow_udf(StringType())
    def batch(values: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.string())]
        for at in range(0, len(values), HELD):
            some = values.slice(at, HELD)
            if some.null_count == len(some):
                parts.append(pa.nulls(len(some), pa.string()))
            else:
                parts.append(pa.array([None if x is None else function(x) for x in some.to_pylist()], pa.string()))
        return pa.concat_arrays(parts)

    return batch


_nfkc = _per_value(lambda s: unicodedata.normalize("NFKC", s))
_entities = _per_value(html.unescape)
_nfkc_entities = _per_value(lambda s: html.unescape(unicodedata.normalize("NFKC", s)))
_no_marks = _per_value(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def _where_needed(batch, c: Column, needed: Column) -> Column:
    return F.coalesce(batch(F.when(needed, c)), c)


def normalize_unicode(c: Column) -> Column:
    """Compatibility composition (NFKC)."""
    return _where_needed(_nfkc, c, c.rlike(NON_ASCII))


def decode_html_entities(c: Column) -> Column:
    return _where_needed(_entities, c, c.contains("&"))


def normalize_and_decode(c: Column) -> Column:
    """NFKC, then entities, in one pass through Python."""
    return _where_needed(_nfkc_entities, c, c.rlike(NON_ASCII) | c.contains("&"))


def remove_accents(c: Column) -> Column:
    """Compatibility decomposition without the combining marks."""
    return _where_needed(_no_marks, c, c.rlike(NON_ASCII))
