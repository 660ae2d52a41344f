"""Forecast calendars, extended panels and padded draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FORECAST_STEPS, STEP_DAYS
from ..functions.scalars import hashed_normal

OBSERVED = ("est_cases", "est_deaths", "hospitalized", "icu")


def forecast_calendar(
    panel: DataFrame, horizon: int = FORECAST_STEPS, step: int = STEP_DAYS
) -> DataFrame:
    """(time, date): week 0, the observed weeks, and ``horizon`` weeks more."""
    observed = panel.select("time", F.col("end_date").alias("date")).distinct()
    ends = observed.agg(
        F.min("date").alias("low"), F.max("date").alias("high"), F.max("time").alias("last")
    )
    ahead = F.transform(
        F.sequence(F.lit(1), F.lit(horizon)),
        lambda k: F.struct(
            (F.col("last") + k).cast("bigint").alias("time"),
            F.date_add("high", k * step).alias("date"),
        ),
    )
    week0 = F.array(
        F.struct(F.lit(0).cast("bigint").alias("time"), F.date_sub("low", step).alias("date"))
    )
    return observed.unionByName(ends.select(F.inline(F.concat(week0, ahead))))


def extend_horizon(
    panel: DataFrame,
    horizon: int = FORECAST_STEPS,
    columns: Sequence[str] = OBSERVED,
    key: str = "place",
) -> DataFrame:
    """Append ``horizon`` weeks to each place, holding its last observation."""
    observed = panel.select(key, "time", *columns)
    newest = F.max_by(
        F.struct("time", *columns), F.struct("start_date", "end_date", "time")
    ).alias("last")
    ahead = (
        panel.groupBy(key).agg(newest)
        .select(key, "last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("k"))
        .select(
            key,
            (F.col("last.time") + F.col("k")).cast("bigint").alias("time"),
            *[F.col(f"last.{c}").alias(c) for c in columns],
        )
    )
    return observed.unionByName(ahead)


def mask_observations(
    panel: DataFrame, horizon: int = FORECAST_STEPS, columns: Sequence[str] = OBSERVED
) -> DataFrame:
    """The extended calendar of each place with every observation missing."""
    extended = extend_horizon(panel, horizon, columns)
    return extended.select(
        "place", "time", *[F.lit(None).cast("double").alias(c) for c in columns]
    )


PAD_MODES = ("zeros", "randn")


def pad_params(
    draws: DataFrame,
    new_names: DataFrame,
    mode: str = "zeros",
    keys: Sequence[str] = ("place_id", "source", "chain", "iteration"),
    seed: int = 1,
    draw_keys: DataFrame | None = None,
) -> DataFrame:
    """Give every draw a value of each new (name, idx): zero, or normal noise.

    The names are one model's parameter list, a value of the plan, whose length
    is set by the model and not by the draws; each draw explodes it, so nothing
    is joined. ``draw_keys`` has one row per draw where such a table exists;
    otherwise the keys are found among the long draws.
    """
    if mode not in PAD_MODES:
        raise ValueError(f"mode must be one of {PAD_MODES}, not {mode!r}")
    listed = new_names.agg(
        F.sort_array(F.collect_set(F.struct("name", "idx"))).alias("names")
    ).scalar()
    padded = (
        (draws.select(*keys).distinct() if draw_keys is None else draw_keys.select(*keys))
        .select(*keys, F.explode(listed).alias("n"))
        .select(*keys, F.col("n.name").alias("name"), F.col("n.idx").alias("idx"))
    )
    noise = hashed_normal(*keys, "name", "idx", seed=seed)
    value = F.lit(0.0) if mode == "zeros" else noise
    return draws.select(*keys, "name", "idx", "value").unionByName(
        padded.withColumn("value", value)
    )
