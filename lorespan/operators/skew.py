"""Windows over keys of any size.

A plain window sends all rows of a key to one task. The functions here cut each key into buckets of an
ordered column, work inside the buckets, and correct the result with a prefix over one row per bucket. A key that
holds a third of the table is then spread over all its buckets.

``bucket`` must not decrease along ``order``. For an integer position use ``floor(position / width)``, for a time its
day or hour.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lorespan.functions.text import col

BUCKET = "_bucket"


def width_bucket(c: Column | str, width: int = 1024) -> Column:
    return F.floor(col(c) / width)


VALUE_BUCKET = "_value_bucket"


def with_value_bucket(df: DataFrame, c: str, coarse: int = 32, fine: int = 32) -> DataFrame:
    """Add ``_value_bucket``, which never decreases with the number ``c``; rows spread evenly over ``coarse * fine``.

    Bounds are approximate percentiles of the column itself, taken by a scalar subquery of fixed size, so any range
    of values is cut as finely as any other. Only the order of buckets matters for the callers, not their exact size.
    """
    n = coarse * fine
    v = col(c).cast("double")
    steps = [k / n for k in range(1, n)]
    cuts = F.struct(F.percentile_approx(v, steps[fine - 1 :: fine]).alias("c"), F.percentile_approx(v, steps).alias("f"))
    bounds = F.col("_bounds")
    below = lambda values: F.size(F.filter(values, lambda b: b < v))
    first = below(bounds["c"])
    bucket = first * (fine + 1) + below(F.slice(bounds["f"], first * fine + 1, fine))
    return df.withColumn("_bounds", df.agg(cuts).scalar()).withColumn(VALUE_BUCKET, bucket).drop("_bounds")


def _cells(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Add the bucket and ``_cell``, a struct of key and bucket: never null, and equal where its fields are equal or
    both null, so windows and joins on it share one partitioning."""
    return df.withColumn(BUCKET, bucket).withColumn("_cell", F.struct(*keys, BUCKET))


def _key_of_cell(keys: Sequence[str]) -> list[Column]:
    return [F.col("_cell")[k] for k in keys]


def side_by_side(*single_rows: DataFrame) -> DataFrame:
    """Aggregates of one row each as one row, without a join."""
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), single_rows)
    return together.agg(*[F.first(c, ignorenulls=True).alias(c) for c in together.columns])


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null."""
    key = F.struct(*keys)
    r = right.withColumn("_k", key).drop(*keys)
    return left.withColumn("_k", key).join(r, "_k", how).drop("_k")


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    sums: Mapping[str, Column],
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add running sums (own row included) per key; ``totals`` names key totals: ``{total column: sums column}``.

    ``order`` must be total within the key. The running count is ``{"pos": lit(1)}``.
    """
    totals = totals or {}
    cut = _cells(df, keys, bucket).select("*", *[v.alias(f"_v_{n}") for n, v in sums.items()])
    per_bucket = cut.groupBy("_cell").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    whole = Window.partitionBy(*_key_of_cell(keys))
    before = whole.orderBy(F.col("_cell")[BUCKET]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        "_cell",
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(whole).alias(t) for t, n in totals.items()],
    )
    inside = Window.partitionBy("_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select(*df.columns, "_cell", *[F.sum(f"_v_{n}").over(inside).alias(f"_v_{n}") for n in sums])
    return local.join(offsets, "_cell").select(
        *df.columns, *[(F.col(f"_o_{n}") + F.col(f"_v_{n}")).alias(n) for n in sums], *totals
    )


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, name: str = "pos"
) -> DataFrame:
    """Row number per key (from 1) without bringing a key together."""
    return prefix_sums(df, keys, order, bucket, {name: F.lit(1).cast("long")})


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, name: str
) -> DataFrame:
    """``lag(value)`` per key: inside a bucket by window, at a bucket's first row from the previous bucket."""
    cut = _cells(df, keys, bucket)
    inside = Window.partitionBy("_cell").orderBy(*order)
    last = cut.groupBy("_cell").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    along = Window.partitionBy(*_key_of_cell(keys)).orderBy(F.col("_cell")[BUCKET])
    carried = last.select("_cell", F.lag("_last").over(along).alias("_carried"))
    local = cut.withColumn("_before", F.lag(value).over(inside)).withColumn("_nth", F.row_number().over(inside))
    return local.join(carried, "_cell").select(
        *df.columns, F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col("_before")).alias(name)
    )


def previous_rows(
    df: DataFrame, keys: Sequence[str], pos: str, n: int, payload: Column, name: str, width: int = 1024
) -> DataFrame:
    """Array of ``payload`` over the ``n`` rows before each row, oldest first.

    ``pos`` is a dense row number from 1. Blocks of ``width`` positions also receive the last ``n`` rows of the block
    before them, so no task needs the whole key.
    """
    keys = list(keys)
    width = max(width, n)
    block = F.floor((F.col(pos) - 1) / width)
    nearly_over = (F.col(pos) - 1) % width >= width - n
    spread = df.withColumn("_payload", payload).withColumn(
        "_block",
        F.explode(F.when(nearly_over, F.array(block, block + 1)).otherwise(F.array(block))),
    )
    frame = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(-n, -1)
    return (
        spread.withColumn(name, F.collect_list("_payload").over(frame))
        .where(F.col("_block") == block)
        .drop("_block", "_payload")
    )


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, name: str = "rn") -> DataFrame:
    """The first ``n`` rows per key. Spark limits each map task to ``n`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first by ``order``."""
    return first_rows(df, keys, order, 1, "_rn").drop("_rn")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: Column | str, probabilities: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Exact interpolated quantiles per key.

    Values are counted first, so copies travel once; ranks come from bucket prefixes, and only the two values around
    each wanted rank are kept. Keys without a value give no row.
    """
    keys = list(keys)
    counted = (
        df.select(*keys, col(value).cast("double").alias("_x"))
        .where(F.col("_x").isNotNull() & ~F.isnan("_x"))
        .groupBy(*keys, "_x")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    cut = with_value_bucket(counted, "_x")
    ranked = prefix_sums(cut, keys, ["_x"], F.col(VALUE_BUCKET), {"_hi": F.col("_c")}, {"_n": "_hi"})
    outs = []
    for p, name in zip(probabilities, names, strict=True):
        at = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.floor(at) + 1, F.ceil(at) + 1
        holds = lambda rank: (F.col("_hi") - F.col("_c") < rank) & (rank <= F.col("_hi"))
        a, b = F.max(F.when(holds(lo), F.col("_x"))), F.max(F.when(holds(hi), F.col("_x")))
        outs.append((a + (b - a) * F.max(at - F.floor(at))).alias(name))
    return ranked.groupBy(*keys).agg(*outs)
