"""Profile of any table: one pass per question, whatever the columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, DateType, TimestampNTZType, TimestampType

from lorespan.operators.concordance import kendall
from lorespan.operators.dedup import duplicate_rows
from lorespan.operators.skew import VALUE_BUCKET, exact_quantiles, join_on, prefix_sums, side_by_side, with_value_bucket
from lorespan.session import scratch_path


def kinds(df: DataFrame) -> dict[str, str]:
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, NumericType):
            out[f.name] = "numeric"
        elif isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)):
            out[f.name] = "datetime"
        elif isinstance(f.dataType, BooleanType):
            out[f.name] = "boolean"
        else:
            out[f.name] = "categorical" if isinstance(f.dataType, StringType) else "other"
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in kinds(df).items() if k == "numeric"]


def columns_table(df: DataFrame) -> DataFrame:
    """Name, position, type and kind of every column."""
    kind = kinds(df)
    rows = [(i, f.name, f.dataType.simpleString(), kind[f.name]) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position long, name string, type string, kind string")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def _missing(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.typeName()
    return F.col(c).isNull() | F.isnan(c) if kind in ("double", "float") else F.col(c).isNull()


def missing_values(df: DataFrame) -> DataFrame:
    """Nulls per column with their percentage, in one scan."""
    wide = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(_missing(df, c)).alias(c) for c in df.columns]
    )
    return wide.unpivot(["_n"], df.columns, "column", "missing").select(
        "column", "missing", F.coalesce(F.round(F.col("missing") / F.col("_n") * 100, 2), F.lit(0.0)).alias("percentage")
    )


def null_row_count(df: DataFrame) -> DataFrame:
    any_null = F.lit(False)
    for c in df.columns:
        any_null = any_null | _missing(df, c)
    return df.agg(F.count_if(any_null).alias("null_rows"))


def value_counts(df: DataFrame, column: str, normalize: bool = False) -> DataFrame:
    """Frequency of every value, null included."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    if not normalize:
        return counts
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.select(column, "count", F.round(F.col("count") / total, 6).alias("share"))


def unique_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def describe(df: DataFrame) -> DataFrame:
    """Count, distinct values, most frequent value, mean, deviation, extremes and quartiles of every column.

    Numbers are summed in one scan; quartiles, distinct and most frequent values come from value counts, which are
    spread over (column, value).
    """
    kind = kinds(df)
    numeric = [c for c in df.columns if kind[c] == "numeric"]
    text = [c for c in df.columns if kind[c] != "numeric"]
    count = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "count")
    out = count
    if text:
        cast = df.select(*[F.col(c).cast("string").alias(c) for c in text])
        values = (
            cast.unpivot([], text, "column", "v").where("v is not null").groupBy("column", "v")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        tops = values.groupBy("column").agg(
            F.count(F.lit(1)).alias("unique"), F.min(F.struct((-F.col("n")).alias("n"), F.col("v").alias("v"))).alias("t")
        ).select("column", "unique", F.col("t.v").alias("top"), (-F.col("t.n")).alias("freq"))
        out = join_on(out, tops, ["column"], "left")
    if numeric:
        cast = df.select(*[F.col(c).cast("double").alias(c) for c in numeric])
        stats = cast.agg(
            *[
                F.struct(
                    F.round(F.avg(c), 6).alias("mean"),
                    F.round(F.stddev_samp(c), 6).alias("std"),
                    F.min(c).alias("min"),
                    F.max(c).alias("max"),
                ).alias(c)
                for c in numeric
            ]
        ).unpivot([], numeric, "column", "s").select("column", "s.*")
        quartiles = exact_quantiles(
            cast.unpivot([], numeric, "column", "v"), ["column"], "v", [0.25, 0.5, 0.75], ["q25", "q50", "q75"]
        )
        rounded = quartiles.select("column", *[F.round(q, 6).alias(q) for q in ("q25", "q50", "q75")])
        out = join_on(join_on(out, stats, ["column"], "left"), rounded, ["column"], "left")
    return out


#: Products, and pairs with values of their own, that one aggregate computes: more are past what code generation compiles well.
_PRODUCTS, _PAIRS = 40, 6


def _correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson of every pair.

    Where no value is missing, all pairs share the columns' sums: means come from a first pass, products of differences
    from a second one. Else every pair has the rows where both are present.
    """
    pairs = list(combinations(range(len(columns)), 2))
    marks = [F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high")) for c in columns]
    rows, *marks = df.agg(F.count(F.lit(1)), *marks).first()
    whole = rows > 0 and all(m.n == rows and m.low < m.high and math.isfinite(m.mean) and math.isfinite(m.high - m.low) for m in marks)
    found = None
    if whole:
        df = df.select(*[(F.col(c) - F.lit(m.mean)).alias(f"x{i}") for i, (c, m) in enumerate(zip(columns, marks))])
    size = _PRODUCTS if whole else _PAIRS
    for at in range(0, len(pairs), size):
        own = pairs[at : at + size]
        if whole:
            used = sorted({i for pair in own for i in pair})
            sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"{i}_{j}") for i, j in [*own, *((i, i) for i in used)]]
            wide = df.agg(*sums).select(*[(F.col(f"{i}_{j}") / F.sqrt(F.col(f"{i}_{i}") * F.col(f"{j}_{j}"))).alias(f"{at + k}") for k, (i, j) in enumerate(own)])
        else:
            wide = df.agg(*[F.corr(columns[i], columns[j]).alias(f"{at + k}") for k, (i, j) in enumerate(own)])
        long = wide.unpivot([], wide.columns, "_i", "correlation")
        found = long if found is None else found.union(long)
    if found is None:
        return df.sparkSession.createDataFrame([], "left string, right string, correlation double")
    left = F.element_at(F.array(*[F.lit(columns[a]) for a, _ in pairs]), F.col("_i").cast("int") + 1)
    right = F.element_at(F.array(*[F.lit(columns[b]) for _, b in pairs]), F.col("_i").cast("int") + 1)
    return found.select(left.alias("left"), right.alias("right"), F.round("correlation", 6).alias("correlation"))


def _mean_ranks(values: DataFrame, series: Sequence[str]) -> DataFrame:
    """Mean rank of every value ``_v`` within its series, less the middle rank, which keeps later sums small."""
    counts = values.groupBy(*series, "_v").agg(F.count(F.lit(1)).alias("_c"))
    cut = with_value_bucket(counts, "_v")
    ranked = prefix_sums(cut, list(series), ["_v"], F.col(VALUE_BUCKET), {"_hi": F.col("_c")}, {"_all": "_hi"})
    mean = F.col("_hi") - (F.col("_c") - 1) / 2 - (F.col("_all") + 1) / 2
    return ranked.select(*series, "_v", mean.alias("_rank"))


def _ranked_columns(rows: DataFrame, long: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` with every column's values replaced by their mean ranks.

    Ranks are stored by column, so each is joined to whole rows by itself and a column of few values is broadcast; the result
    is stored too, as it is read twice.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "ranks")
    _mean_ranks(long, ["_side"]).write.partitionBy("_side").parquet(path)
    ranks = spark.read.parquet(path)
    for i, c in enumerate(columns):
        own = ranks.where(F.col("_side") == i).select(F.col("_v").alias(c), F.col("_rank").alias(f"_{i}"))
        rows = rows.join(own, c).drop(c)
    path = scratch_path(spark, "ranked")
    rows.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(columns)]).write.parquet(path)
    return spark.read.parquet(path)


def _rank_correlation(values: DataFrame, columns: Sequence[str], pairwise: bool) -> DataFrame:
    """Pearson of mean ranks, which are made in one pass whatever the number of columns.

    Values are taken as (series, row, value): a series is a column, or a side of a pair of columns. The adaptive skew
    join splits a frequent value.
    """
    present = lambda c: ~(F.col(c).isNull() | F.isnan(c))
    rows = values.withColumn("_row", F.monotonically_increasing_id())
    pairs = list(combinations(range(len(columns)), 2))
    if pairwise:
        sides = [
            F.when(present(columns[a]) & present(columns[b]), F.struct(F.lit(i).alias("_pair"), F.lit(side).alias("_side"), F.col(columns[c]).alias("_v")))
            for i, (a, b) in enumerate(pairs)
            for side, c in ((0, a), (1, b))
        ]
        series = ["_pair", "_side"]
    else:
        for c in columns:
            rows = rows.where(present(c))
        sides = [F.struct(F.lit(i).alias("_side"), F.col(c).alias("_v")) for i, c in enumerate(columns)]
        series = ["_side"]
    long = rows.select("_row", F.explode(F.array_compact(F.array(*sides))).alias("_x")).select("_row", "_x.*")
    if not pairwise:
        return _correlations(_ranked_columns(rows.drop("_row"), long, columns), columns)
    ranked = long.join(_mean_ranks(long, series), [*series, "_v"])
    side = lambda i: F.max(F.when(F.col("_side") == i, F.col("_rank"))).alias(f"{i}")
    both = ranked.groupBy("_row", "_pair").agg(side(0), side(1))
    found = both.groupBy("_pair").agg(F.round(F.corr("0", "1"), 6).alias("correlation"))
    names = values.sparkSession.createDataFrame(
        [(i, columns[a], columns[b]) for i, (a, b) in enumerate(pairs)], "_pair int, left string, right string"
    )
    return names.join(found, "_pair", "left").select("left", "right", "correlation")


def correlation(
    df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None, pairwise: bool = True
) -> DataFrame:
    """Correlation of every pair of numeric columns.

    Spearman is Pearson over mean ranks; Kendall is tau-b, always pairwise (:func:`concordance.kendall`). With ``pairwise``, ranks of a pair are taken over the rows where both are
    present, which costs a pass over the values per pair; without, over the rows where all columns are.
    """
    columns = list(columns or numeric_columns(df))
    if not columns:
        raise ValueError("no numeric columns")
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if method == "pearson":
        return _correlations(values, columns)
    if method == "kendall":
        return kendall(values, columns)
    if method != "spearman":
        raise ValueError(f"unknown method: {method}")
    return _rank_correlation(values, columns, pairwise)


def summary(df: DataFrame) -> DataFrame:
    """Rows, columns, columns by kind, duplicated rows, rows with nulls."""
    kind = list(kinds(df).values())
    counted = side_by_side(shape(df), duplicate_rows(df).select("duplicate_rows"), null_row_count(df))
    return counted.withColumn("numeric_columns", F.lit(kind.count("numeric")).cast("long")).withColumn(
        "categorical_columns", F.lit(kind.count("categorical")).cast("long")
    )


def sample(df: DataFrame, n: int = 5, seed: int = 42, key: str | None = None) -> DataFrame:
    """``n`` rows in the order of a seeded hash of the key: the same rows on every run and cluster."""
    columns = [key] if key else df.columns
    return df.orderBy(F.xxhash64(F.lit(seed), *columns), *columns).limit(n)


