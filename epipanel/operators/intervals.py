"""Interval tables of generated quantities and predictive draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import INTERVAL_WIDTHS
from .draws import DRAW_KEYS, align_time_index
from .packed import pack_draws, unpack, with_running_total
from .quantiles import median_qi

GROUP = ("place_id", "source")


def attach_dates(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Date of each week; scalars have no week and stay without a date."""
    return df.join(calendar.select("time", "date"), "time", "left").drop("time")


def attach_place(df: DataFrame, dim: DataFrame) -> DataFrame:
    return df.join(
        dim.select(F.col("id").alias("place_id"), "place"), "place_id", "left"
    )


def gq_intervals(
    draws: DataFrame,
    calendar: DataFrame,
    widths: Sequence[float] = INTERVAL_WIDTHS,
) -> DataFrame:
    """Intervals of every generated quantity, dated where it is a series."""
    asked = median_qi(draws, (*GROUP, "name", "idx"), "value", widths)
    return attach_dates(align_time_index(asked), calendar).drop("idx")


def scalar_intervals(intervals: DataFrame) -> DataFrame:
    return intervals.where(F.col("date").isNull()).drop("date")


def vector_intervals(intervals: DataFrame) -> DataFrame:
    return intervals.where(F.col("date").isNotNull())


def scalar_vector_split(intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scalar quantities, which have no date, and series."""
    return scalar_intervals(intervals), vector_intervals(intervals)


def cumulative_by_draw(
    draws: DataFrame,
    name: str = "new_deaths",
    out: str = "cumulative_deaths",
    keys: Sequence[str] = DRAW_KEYS,
) -> DataFrame:
    """Running total of one series of long draws; missing from the first missing week on."""
    packed = pack_draws(draws.where(F.col("name") == name), keys)
    return unpack(with_running_total(packed, name, out, alone=True), keys)


def cumulative_intervals(
    packed: DataFrame,
    name: str = "new_deaths",
    out: str = "cumulative_deaths",
    widths: Sequence[float] = INTERVAL_WIDTHS,
) -> DataFrame:
    """Intervals of the running total of one series of packed draws."""
    running = unpack(with_running_total(packed, name, out, alone=True))
    return median_qi(running, (*GROUP, "name", "idx"), "value", widths)


def predictive_intervals(
    packed: DataFrame,
    calendar: DataFrame,
    widths: Sequence[float] = INTERVAL_WIDTHS,
) -> DataFrame:
    """Intervals of each predicted stream and of cumulative deaths, dated, from packed draws.

    A draw's running total is one more series of its row, so streams and totals
    are read and summarised together.
    """
    both = unpack(with_running_total(packed, "new_deaths", "cumulative_deaths"))
    asked = median_qi(both, (*GROUP, "name", "idx"), "value", widths)
    timed = asked.withColumn("time", F.col("idx").cast("bigint")).drop("idx")
    return attach_dates(timed, calendar)
