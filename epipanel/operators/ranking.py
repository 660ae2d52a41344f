"""Positions and top rows inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    block: Column,
    out: str = "position",
) -> DataFrame:
    """1-based row number inside ``keys`` by ``order``, split over blocks.

    ``block`` is a coarse, non-decreasing function of the order. Rows are
    numbered inside (keys, block) and shifted by the number of rows in earlier
    blocks, so a group that holds much of the data is spread over its blocks.
    Only the block counts, already summed, meet in one window.
    """
    marked = df.withColumn("_block", block)
    group = [*keys, "_block"]
    earlier = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        marked.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return (
        marked.withColumn("_inside", inside)
        .join(offsets, group)
        .withColumn(out, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_block", "_inside", "_before")
    )


def range_positions(df: DataFrame, order: Sequence[str], out: str = "position") -> DataFrame:
    """1-based row number of all rows by ``order``.

    Rows are dealt out by ranges of the order and stored with the number of
    their range. Each range is numbered by itself and shifted by the rows of
    the ranges before it; one row per range meets in one window.
    """
    dealt = stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        dealt.withColumn("_inside", inside).join(offsets, "_range")
        .withColumn(out, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_range", "_inside", "_before")
    )


def finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def top_n_finite(
    df: DataFrame, keys: Sequence[str], score: str, n: int, tie: str, out: str = "rank"
) -> DataFrame:
    """Best ``n`` finite scores per group, ties by ``tie``.

    The rank filter becomes a window group limit, so each task keeps at most
    ``n`` rows per group before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie).asc())
    return (
        df.where(finite(score)).withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)
    )
