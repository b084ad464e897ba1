"""Filters, projections and pages over any table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lorespan.functions import text as t
from lorespan.operators.skew import VALUE_BUCKET, position, with_value_bucket

# Phrases that mark an injected prompt; the e-mail pattern of user records.
INJECTION_PHRASES = (
    "ignore previous",
    "ignore all previous",
    "system prompt",
    "developer message",
    "reveal prompt",
    "act as system",
    "forget previous",
    "bypass",
    "override instructions",
    "ignore safety",
    "jailbreak",
    "disable safety",
)
EMAIL = "^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$"


def _known(df: DataFrame, columns: Sequence[str]) -> None:
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")


def preview(df: DataFrame, order: Sequence[str | Column], rows: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(rows)


def tail(df: DataFrame, order: Sequence[str], rows: int = 5) -> DataFrame:
    """The last rows, in order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(rows).orderBy(*order)


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    _known(df, columns)
    return df.select(*columns)


def _numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``_pos``, the position (from 1) in an order that is total; no task holds more than a bucket of the order.

    Buckets follow the first column: its number, or that of a text's first six bytes.
    """
    first = F.col(order[0])
    kind = df.schema[order[0]].dataType.typeName()
    if kind in ("string", "binary"):
        number = F.conv(F.rpad(F.hex(F.substring(first.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    elif kind.startswith(("timestamp", "date")):
        number = F.unix_micros(first.cast("timestamp")).cast("double")
    else:
        number = first.cast("double")
    cut = with_value_bucket(df.withColumn("_number", number), "_number").drop("_number")
    return position(cut, [], order, F.col(VALUE_BUCKET), "_pos").drop(VALUE_BUCKET)


def row_at(df: DataFrame, order: Sequence[str], index: int) -> DataFrame:
    """The row at an ordinal (from 0) of the order."""
    if index < 0:
        raise ValueError("index must not be negative")
    return _numbered(df, order).where(F.col("_pos") == index + 1).drop("_pos")


def filter_rows(df: DataFrame, column: str, value: object) -> DataFrame:
    _known(df, [column])
    return df.where(F.col(column) == F.lit(value))


def search_any(df: DataFrame, keyword: str) -> DataFrame:
    """Any column, as text, contains the keyword (case ignored)."""
    hit = reduce(lambda a, c: a | F.coalesce(t.contains_ci(F.col(c).cast("string"), keyword), F.lit(False)), df.columns, F.lit(False))
    return df.where(hit)


def search_text(df: DataFrame, keyword: str, text: str = "text") -> DataFrame:
    return df.where(t.contains_ci(F.col(text), keyword))


def starts_or_ends(df: DataFrame, prefix: str | None = None, suffix: str | None = None, text: str = "text") -> DataFrame:
    if prefix is not None:
        df = df.where(F.startswith(F.col(text), F.lit(prefix)))
    return df if suffix is None else df.where(F.endswith(F.col(text), F.lit(suffix)))


def injected(c: Column) -> Column:
    """The text holds one of the phrases of prompt injection."""
    lower = F.lower(c)
    return reduce(lambda a, p: a | F.coalesce(lower.contains(p), F.lit(False)), INJECTION_PHRASES, F.lit(False))


def injection_report(df: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(injected(F.col(text))).alias("suspicious")
    )


def page(df: DataFrame, order: Sequence[str], number: int = 1, size: int = 25) -> DataFrame:
    """A page of the order, however far behind; its rows come in no particular order."""
    if number < 1 or size < 1:
        raise ValueError("page and size start at 1")
    start = (number - 1) * size
    return _numbered(df, order).where((F.col("_pos") > start) & (F.col("_pos") <= start + size)).drop("_pos")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table; Parquet answers from its footers."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def validate_users(df: DataFrame, email: str = "email", name: str = "username") -> DataFrame:
    """Add rule flags: valid e-mail address, name of at least three characters."""
    return df.withColumn("email_valid", F.coalesce(F.col(email).rlike(EMAIL), F.lit(False))).withColumn(
        "name_valid", F.coalesce(F.length(t.strip(F.col(name))) >= 3, F.lit(False))
    )


def user_facts(
    logins: DataFrame, as_of: str, user: str = "user_id", ts: str = "ts"
) -> DataFrame:
    """Age of the account in days, number of logins and last login, from the user's events."""
    facts = logins.groupBy(user).agg(
        F.min(ts).alias("created_at"), F.count(F.lit(1)).alias("logins"), F.max(ts).alias("last_login")
    )
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("created_at"))
    return facts.select(user, age.alias("age_days"), "logins", "last_login")
