"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None
    rows: tuple[int, ...]


ENTRIES: dict[str, Entry] = {}


def query(name: str, *rows: int, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query for the given inventory rows."""

    def add(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query registered twice: {name}")
        ENTRIES[name] = Entry(run, sql, rows)
        return run

    return add
