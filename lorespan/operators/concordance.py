"""Kendall's tau-b: pairs of rows that two columns order alike or against each other, without comparing rows in pairs.

Distinct points carry their number of rows. They are dealt to ranges of (x, y), and once more to ranges of (y, x), so
however often a value occurs, ranges hold about as many points each. Two points that are ordered one way by (x, y) and the
other way by (y, x) are discordant, and they are counted where they are told apart: in different ranges of both orders on
the grid of ranges, which is small; within a range of the first order, or of the second, in one task per range.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lorespan.session import scratch_path

#: Points of a range, and the most ranges: the grid has at most the square of that many cells.
POINTS, RANGES = 250_000, 4096


def inversions(rank: np.ndarray, weight: np.ndarray) -> float:
    """Sum of the products of weights over i < j with ``rank[i] > rank[j]``; ranks are 0, 1, ... in some order.

    From the top bit of the ranks down: two ranks part at one bit, where they stand in one group of equal higher bits. A
    stable sort by one bit more keeps the given order inside the groups.
    """
    found, n = 0.0, len(rank)
    for bit in range(max(n - 1, 1).bit_length() - 1, -1, -1):
        upper = (rank >> bit) & 1
        group = rank >> (bit + 1)
        before = np.cumsum(weight * upper) - weight * upper
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        before -= np.repeat(before[start], np.diff(np.r_[start, n]))
        found += float(np.sum(weight * (1 - upper) * before))
        order = np.argsort(rank >> bit, kind="stable")
        rank, weight = rank[order], weight[order]
    return found


def _within(first: str, second: str):
    """Count a range's discordant pairs of points; points with equal ``first`` stand in the order of ``second``."""

    def count(part: pd.DataFrame) -> pd.DataFrame:
        by_y = np.lexsort((part["x"].to_numpy(), part["y"].to_numpy()))
        rank = np.empty(len(part), dtype=np.int64)
        rank[by_y] = np.arange(len(part))
        order = np.lexsort((rank, part[second].to_numpy(), part[first].to_numpy()))
        n = inversions(rank[order], part["w"].to_numpy().astype("float64")[order])
        return pd.DataFrame({"pair": part["pair"].iloc[:1], "n": [n]})

    return count


def _points(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``pair, x, y, w``: the distinct points of every pair of columns and their rows."""
    present = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    value = lambda c: F.col(c) + F.lit(0.0)  # noqa: E731  # one zero
    both = [
        F.when(present(a) & present(b), F.struct(F.lit(i).alias("pair"), value(a).alias("x"), value(b).alias("y")))
        for i, (a, b) in enumerate(pairs)
    ]
    rows = df.select(F.explode(F.array_compact(F.array(*both))).alias("p")).select("p.*")
    return rows.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w"))


def _grid(points: DataFrame, ranges: int) -> DataFrame:
    """``pair, n``: discordant rows in different ranges of both orders.

    Two ranges of the first order part at one bit, below equal higher bits. For every bit and group of equal higher bits, the
    cells of either side are summed by the range of the second order, so a window has at most as many rows as there are ranges.
    """
    cells = points.groupBy("pair", "a", "b").agg(F.sum("w").cast("double").alias("w"))
    bits = F.explode(F.sequence(F.lit(0), F.lit(max(ranges - 1, 1).bit_length() - 1))).alias("bit")
    cut = cells.select("pair", "a", "b", "w", bits)
    group = F.expr("shiftright(a, bit + 1)").alias("group")
    side = F.expr("shiftright(a, bit)").bitwiseAND(F.lit(1))
    level = cut.select("pair", "bit", group, "b", "w", side.alias("side")).groupBy("pair", "bit", "group", "b").agg(
        F.sum(F.when(F.col("side") == 0, F.col("w")).otherwise(0.0)).alias("low"),
        F.sum(F.when(F.col("side") == 1, F.col("w")).otherwise(0.0)).alias("high"),
    )
    above = F.expr("sum(low) over (partition by pair, bit, group order by b desc rows between unbounded preceding and 1 preceding)")
    counted = level.select("pair", (F.col("high") * F.coalesce(above, F.lit(0.0))).alias("n"))
    return counted.groupBy("pair").agg(F.sum("n").alias("n"))


def _tied(points: DataFrame, *by: str) -> DataFrame:
    """``pair, t``: pairs of rows with equal values."""
    n = F.sum("w").cast("double") if by != ("x", "y") else F.first("w").cast("double")
    same = points.groupBy("pair", *by).agg(n.alias("n"))
    return same.groupBy("pair").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("t"))


def kendall(df: DataFrame, columns: Sequence[str], points: int = POINTS, ranges: int = RANGES) -> DataFrame:
    """``left, right, correlation`` (tau-b, six places) of every pair of numeric columns.

    A pair has the rows where both values are present and not NaN; it is null if there are none or a column has one value.
    Counts of pairs are doubles: exact up to 2^53, beyond that to about fifteen digits.
    """
    spark = df.sparkSession
    pairs = list(combinations(columns, 2))
    names = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, left string, right string")
    if not pairs:
        return names.select("left", "right", F.lit(None).cast("double").alias("correlation"))
    stored = _kept(_points(df, pairs))
    cut = min(ranges, max(1, -(-stored.count() // points)))
    dealt = _kept(stored.repartitionByRange(cut, "pair", "x", "y").withColumn("a", F.spark_partition_id()))
    dealt = _kept(dealt.repartitionByRange(cut, "pair", "y", "x").withColumn("b", F.spark_partition_id()))
    # A number of partitions may have been raised by the session, so the ranges are counted as they are.
    used = (dealt.agg(F.max("a")).first()[0] or 0) + 1
    found = [
        dealt.groupBy("pair", "a").applyInPandas(_within("x", "y"), "pair int, n double"),
        dealt.groupBy("pair", "b").applyInPandas(_within("a", "y"), "pair int, n double"),
        _grid(dealt, used),
    ]
    against = found[0].union(found[1]).union(found[2]).groupBy("pair").agg(F.sum("n").alias("d"))
    total = dealt.groupBy("pair").agg(F.sum("w").cast("double").alias("n"))
    wide = names.join(total, "pair", "left").join(against, "pair", "left")
    for name, by in (("tx", ("x",)), ("ty", ("y",)), ("txy", ("x", "y"))):
        wide = wide.join(_tied(dealt, *by).withColumnRenamed("t", name), "pair", "left")
    return wide.select("left", "right", F.round(_tau(), 6).alias("correlation"))


def _tau() -> Column:
    every = F.col("n") * (F.col("n") - 1) / 2
    agree_less_against = every - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("d")
    below = F.sqrt(every - F.col("tx")) * F.sqrt(every - F.col("ty"))
    return F.when(below > 0, agree_less_against / below)


def _kept(df: DataFrame) -> DataFrame:
    """Stored: ranges are drawn from a sample, so they must be made once and not again with every use."""
    path = scratch_path(df.sparkSession, "points")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
