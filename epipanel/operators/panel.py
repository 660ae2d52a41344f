"""From place-day feeds to the weekly panel, its rollups and initial values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    DEATH_DELAY_SHIFT,
    EARLIEST_DATE,
    HOLDBACK_DAYS,
    NOT_PLACES,
    SMOOTHING_OFFSET,
    STEP_DAYS,
)
from ..functions.scalars import (
    days_between,
    half_even_round,
    last_by,
    sum_strict,
    week_index,
)
from .ranking import range_positions

LEVELS = ("place", "region", "state")


# ---------------------------------------------------------------- filters

def filter_place(df: DataFrame, key: str, wanted) -> DataFrame:
    return df.where(F.col(key) == F.lit(wanted))


def filter_date_range(df: DataFrame, low=None, high=None, date: str = "date") -> DataFrame:
    """Inclusive window; either end may be left open."""
    if low is not None:
        df = df.where(F.col(date) >= low)
    if high is not None:
        df = df.where(F.col(date) <= high)
    return df


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(columns) if columns else None)


def fill_missing(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.fillna(values)


# ---------------------------------------------------------------- feeds

def clean_place_feed(feed: DataFrame) -> DataFrame:
    """County rows of the raw feed, as place-day rows with population."""
    return (
        feed.where((F.col("area_type") == "County") & ~F.col("area").isin(*NOT_PLACES))
        .withColumnRenamed("area", "place")
        .drop("area_type")
    )


def place_daily(cleaned: DataFrame) -> DataFrame:
    """Complete case and death rows."""
    return drop_incomplete(cleaned.select("place", "date", "cases", "deaths", "cumulative_deaths"))


def clean_census_feed(feed: DataFrame) -> DataFrame:
    return feed.select(
        F.col("county").alias("place"),
        F.col("todays_date").alias("date"),
        F.col("hospitalized_covid_confirmed_patients").alias("hospitalized"),
        F.col("icu_covid_confirmed_patients").alias("icu"),
    )


def daily_full_join(cases: DataFrame, census: DataFrame) -> DataFrame:
    """All place-days of either feed; a missing census is zero, missing cases stay null."""
    joined = cases.join(census, on=["place", "date"], how="full")
    return fill_missing(joined, {"hospitalized": 0.0, "icu": 0.0})


# ---------------------------------------------------------------- reporting window

def count_weighted(df: DataFrame, keys: Sequence[str], weight: str, out: str = "n") -> DataFrame:
    """Weighted count; null weights are skipped."""
    return df.groupBy(*keys).agg(F.sum(weight).alias(out))


def latest_active_date(daily: DataFrame) -> DataFrame:
    """One row: the last date with anyone in hospital."""
    active = count_weighted(daily, ["date"], "hospitalized").where("n > 0")
    return active.agg(F.max("date").alias("latest_date"))


def reporting_window(
    daily: DataFrame,
    earliest: str = EARLIEST_DATE,
    step: int = STEP_DAYS,
    holdback: int = HOLDBACK_DAYS,
) -> DataFrame:
    """One row: latest, first and last date, the window being whole steps."""
    last = F.date_sub("latest_date", holdback)
    start = F.lit(earliest).cast("date")
    lead = F.pmod(days_between(last, start), F.lit(step)) + 1
    return latest_active_date(daily).select(
        "latest_date",
        F.date_add(start, lead.cast("int")).alias("first_date"),
        last.alias("last_date"),
    )


def in_reporting_window(daily: DataFrame, window: DataFrame) -> DataFrame:
    """Days of the window. Its ends are scalar subqueries, not a join."""
    ends = window.select(F.struct("first_date", "last_date").alias("ends")).scalar()
    return filter_date_range(daily, ends["first_date"], ends["last_date"])


# ---------------------------------------------------------------- reporting delay

def delay_ecdf(delay_events: DataFrame) -> DataFrame:
    """(stream, x, F) on every whole day from one below the least delay to the greatest.

    Events are summed per (stream, day) before any window, so a window holds
    one row per day of delay.
    """
    counts = delay_events.groupBy("stream", F.col("delay_days").alias("x")).agg(
        F.count(F.lit(1)).alias("n")
    )
    by_stream = Window.partitionBy("stream")
    ahead = F.lead("x").over(by_stream.orderBy("x"))
    stepped = (
        counts.withColumn("_next", ahead)
        .withColumn("_low", F.min("x").over(by_stream))
        .withColumn(
            "_F",
            F.sum("n").over(by_stream.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
            / F.sum("n").over(by_stream),
        )
    )
    # A day without events keeps the value of the day before it; the day below
    # the first has none.
    held = F.sequence("x", F.coalesce(F.col("_next") - 1, F.col("x")))
    below = F.when(
        F.col("x") == F.col("_low"),
        F.array(F.struct((F.col("x") - 1).alias("x"), F.lit(0.0).alias("F"))),
    ).otherwise(F.array())
    steps = F.transform(held, lambda x: F.struct(x.alias("x"), F.col("_F").alias("F")))
    return stepped.select("stream", F.inline(F.concat(below, steps)))


def ecdf_lookup(
    df: DataFrame, ecdf: DataFrame, stream: str, x: Column | str, out: str
) -> DataFrame:
    """Right-continuous step lookup: 0 below the first day, 1 from the last on; a missing day has no share.

    The ECDF has a row for every day between its ends, so a day held within
    the ends finds its row by equality, and the planner broadcasts the rows
    only where they are few.
    """
    one = ecdf.where(F.col("stream") == stream)
    ends = one.agg(F.struct(F.min("x").alias("first"), F.max("x").alias("last")).alias("ends")).scalar()
    x = F.col(x) if isinstance(x, str) else x
    # greatest and least skip nulls.
    day = F.when(x.isNotNull(), F.least(F.greatest(x, ends["first"]), ends["last"]))
    steps = one.select(F.col("x").alias("_x"), F.col("F").alias(out))
    return df.withColumn("_day", day).join(steps, F.col("_day") == F.col("_x"), "left").drop("_day", "_x")


def delay_correct(
    daily: DataFrame,
    latest_date: Column,
    ecdf: DataFrame,
    death_shift: int = DEATH_DELAY_SHIFT,
) -> DataFrame:
    """Counts over the share reported by now; null where that share is zero."""
    aged = daily.withColumn("days_ago", days_between(latest_date, "date"))
    looked = ecdf_lookup(aged, ecdf, "cases", "days_ago", "cases_est_prop_reported")
    looked = ecdf_lookup(
        looked, ecdf, "deaths", F.col("days_ago") + death_shift, "death_est_prop_reported"
    )
    return looked.withColumn(
        "est_cases", F.try_divide("cases", "cases_est_prop_reported")
    ).withColumn("est_deaths", F.try_divide("deaths", "death_est_prop_reported"))


# ---------------------------------------------------------------- panel

_SUMMED = (
    "cases", "deaths", "est_cases", "est_deaths", "cumulative_deaths", "hospitalized", "icu",
)


def weekly_panel(corrected: DataFrame, origin: Column, step: int = STEP_DAYS) -> DataFrame:
    """One row per place and week counted from ``origin``.

    Every aggregate combines map-side, so a place with many rows costs no more
    than the others after the first stage.
    """
    return (
        corrected.withColumn("time", week_index("date", origin, step))
        .groupBy("place", "time")
        .agg(
            F.min("date").alias("start_date"),
            F.max("date").alias("end_date"),
            sum_strict("cases").alias("cases"),
            sum_strict("deaths").alias("deaths"),
            half_even_round(sum_strict("est_cases")).alias("est_cases"),
            half_even_round(sum_strict("est_deaths")).alias("est_deaths"),
            last_by("cumulative_deaths", "date").alias("cumulative_deaths"),
            last_by("hospitalized", "date").alias("hospitalized"),
            last_by("icu", "date").alias("icu"),
        )
    )


# ---------------------------------------------------------------- mergeable panel

_ADDED = ("cases", "deaths", "est_cases", "est_deaths")
_LAST = ("cumulative_deaths", "hospitalized", "icu")


def panel_state(corrected: DataFrame, origin: Column, step: int = STEP_DAYS) -> DataFrame:
    """What a weekly panel rests on, a row per place and week, in a form that adds up.

    Days, and for each summed column how many of them have a value and their
    sum; the first and last date; the census of the last date.
    """
    return (
        corrected.withColumn("time", week_index("date", origin, step))
        .groupBy("place", "time")
        .agg(
            F.count(F.lit(1)).alias("days"), F.min("date").alias("start_date"), F.max("date").alias("end_date"),
            *[F.count(c).alias(f"{c}_known") for c in _ADDED], *[F.sum(c).alias(f"{c}_sum") for c in _ADDED],
            F.max_by(F.struct(*_LAST), "date").alias("last"),
        )
    )


def merge_states(one: DataFrame, other: DataFrame) -> DataFrame:
    """The state of both feeds' days together; no day of a place may be in both."""
    return one.unionByName(other).groupBy("place", "time").agg(
        F.sum("days").alias("days"), F.min("start_date").alias("start_date"), F.max("end_date").alias("_end"),
        *[F.sum(f"{c}_known").alias(f"{c}_known") for c in _ADDED], *[F.sum(f"{c}_sum").alias(f"{c}_sum") for c in _ADDED],
        F.max_by("last", "end_date").alias("last"),
    ).withColumnRenamed("_end", "end_date").select(*one.columns)


def panel_of(state: DataFrame) -> DataFrame:
    """The weekly panel of a state, as ``weekly_panel`` gives it for the days themselves."""
    strict = {c: F.when(F.col(f"{c}_known") == F.col("days"), F.col(f"{c}_sum")) for c in _ADDED}
    return state.select(
        "place", "time", "start_date", "end_date", strict["cases"].alias("cases"), strict["deaths"].alias("deaths"),
        *[half_even_round(strict[c]).alias(c) for c in ("est_cases", "est_deaths")], *[F.col(f"last.{c}").alias(c) for c in _LAST],
    )


def update_rollup(rolled: DataFrame, merged: DataFrame, late: DataFrame, region_key: DataFrame, state: str) -> DataFrame:
    """The rolled-up panel after a late feed: only its weeks are summed anew, the others are kept.

    ``merged`` is the state with the late feed, ``late`` the state of the feed alone.
    """
    touched = late.select("time").distinct()
    kept = rolled.join(touched, "time", "left_anti").select(*rolled.columns)
    anew = rollup_places(panel_of(merged.join(touched, "time", "left_semi")), region_key, state)
    return kept.unionByName(anew)


def attach_region(df: DataFrame, region_key: DataFrame) -> DataFrame:
    """Left join to the region key; a place without one keeps a null region."""
    return df.join(region_key.select("place", "region"), "place", "left")


def _with_levels(df: DataFrame, region_key: DataFrame, state: str) -> DataFrame:
    """Each row once for its place, once for its region, once for the state."""
    labels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("place").alias("label")),
        F.struct(F.lit(1).alias("level"), F.col("region").alias("label")),
        F.struct(F.lit(2).alias("level"), F.lit(state).alias("label")),
    )
    rest = [c for c in df.columns if c != "place"]
    return attach_region(df, region_key).select(F.inline(labels), *rest)


def rollup_places(
    panel: DataFrame, region_key: DataFrame, state: str, align_dates: bool = False
) -> DataFrame:
    """Panel with region and state rows, in one aggregation.

    Weeks are grouped with their first and last date, so a place that lacks a
    day at either end of a week is summed apart; ``align_dates`` takes the
    week's earliest and latest date instead.
    """
    keys = ["level", "label", "time"]
    bounds = []
    if align_dates:
        bounds = [F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date")]
    else:
        keys += ["start_date", "end_date"]
    totals = _with_levels(panel, region_key, state).groupBy(*keys).agg(
        *bounds, *[sum_strict(c).alias(c) for c in _SUMMED]
    )
    return totals.select(
        F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("level") + 1).alias("level"),
        F.col("label").alias("place"), "time", "start_date", "end_date", *_SUMMED,
    )


def place_dimension(populations: DataFrame, region_key: DataFrame, state: str) -> DataFrame:
    """(id, level, place, population) of places, regions and the state.

    Ids run over (level, place). Places are dealt out by ranges of that order,
    so no task sorts all places, whatever their names begin with.
    """
    distinct = populations.select(
        "place", F.col("population").cast("bigint").alias("population")
    ).distinct()
    totals = _with_levels(distinct, region_key, state).groupBy("level", "label").agg(
        sum_strict("population").cast("bigint").alias("population")
    )
    numbered = range_positions(totals, ["level", "label"], out="id")
    return numbered.select(
        F.col("id").cast("int").alias("id"),
        F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("level") + 1).alias("level"),
        F.col("label").alias("place"),
        "population",
    )


def extend_dictionary(dictionary: DataFrame, seen: DataFrame) -> DataFrame:
    """(id, level, place) of all places ever seen: known ones keep their ids, new ones get the next.

    ``dictionary`` only grows, so draws stored under an id stay with their
    place when others come or go. New places are numbered by (level, place), in
    ranges of that order. A null place is a place.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    known = dictionary.select("level", "place", "id")
    fresh = seen.select("level", "place").distinct().alias("s").join(
        known.alias("d"), (F.col("s.level") == F.col("d.level")) & F.col("s.place").eqNullSafe(F.col("d.place")), "left_anti"
    )
    last = known.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = range_positions(fresh.withColumn("_rank", rank), ["_rank", "place"], out="_at")
    added = numbered.select((F.col("_at") + last).cast("int").alias("id"), "level", "place")
    return known.select("id", "level", "place").unionByName(added)


def initial_values(
    panel: DataFrame, dim: DataFrame, offset: int = SMOOTHING_OFFSET
) -> DataFrame:
    """Week-0 census and deaths, each ``offset`` higher, and who remains.

    One row per place: where week 0 has several (a rollup of places whose weeks
    differ), the one with the earliest start, then end.
    """
    measures = ("hospitalized", "icu", "cumulative_deaths")
    first = panel.where(F.col("time") == 0).groupBy("place").agg(
        F.min_by(F.struct(*measures), F.struct("start_date", "end_date")).alias("first")
    )
    week0 = first.select("place", "first.*").select(
        "place",
        (F.col("hospitalized") + offset).alias("H"),
        (F.col("icu") + offset).alias("ICU"),
        (F.col("cumulative_deaths") + offset).alias("D"),
    )
    return (
        dim.select("id", "place", "population")
        .join(week0, "place", "right")
        .select(
            "id", "place", "population", "H", "ICU", "D",
            (F.col("population") - (F.col("H") + F.col("ICU") + F.col("D"))).alias(
                "remaining_population"
            ),
        )
    )


def observed_weeks(panel: DataFrame) -> DataFrame:
    """The stored panel: week 0 only seeds the initial values."""
    return panel.where(F.col("time") != 0)
