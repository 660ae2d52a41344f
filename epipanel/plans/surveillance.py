"""Feeds to weekly panel, dimension and initial values."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators import panel as P
from ..session import stage, together


class Surveillance:
    """Frames of the ingest job.

    Its results are stored once and read by all that follows: the joined
    place-days, the delay ECDF, the rolled-up panel, the place dimension and
    the initial values. Everything else is lazy over them.
    """

    def __init__(
        self,
        cases: DataFrame,
        census: DataFrame,
        region_key: DataFrame,
        populations: DataFrame,
        delay_events: DataFrame | None,
        state: str,
        ecdf: DataFrame | None = None,
    ):
        """Takes the delays as events, or as an ECDF already stored."""
        self.cases, self.census = cases, census
        self.region_key, self.populations = region_key, populations
        self.delay_events, self.state = delay_events, state
        if ecdf is not None:
            self.ecdf = ecdf

    @cached_property
    def daily(self) -> DataFrame:
        """All place-days, stored: the feeds are read once."""
        return stage(P.daily_full_join(self.cases, self.census))

    @cached_property
    def window(self) -> DataFrame:
        return P.reporting_window(self.daily)

    @cached_property
    def ecdf(self) -> DataFrame:
        """Reported share by days of delay, stored: the events are read once."""
        return stage(P.delay_ecdf(self.delay_events))

    @cached_property
    def bounds(self) -> Row:
        """latest_date, first_date, last_date and first_day, the first one with data: one row, told once.

        As literals they prune the place-days, where subqueries would each be a
        job in every plan that names them.
        """
        window = self.window
        first = P.in_reporting_window(self.daily.select("date"), window).agg(F.min("date"))
        return window.withColumn("first_day", first.scalar()).first()

    @cached_property
    def corrected(self) -> DataFrame:
        together(lambda: self.bounds, lambda: self.ecdf)
        ends = self.bounds
        inside = P.filter_date_range(self.daily, F.lit(ends.first_date), F.lit(ends.last_date))
        return P.delay_correct(inside, F.lit(ends.latest_date).cast("date"), self.ecdf)

    @cached_property
    def weekly(self) -> DataFrame:
        return P.weekly_panel(self.corrected, F.lit(self.bounds.first_day).cast("date"))

    @cached_property
    def rolled(self) -> DataFrame:
        """Panel of places, regions and state, stored."""
        return stage(P.rollup_places(self.weekly, self.region_key, self.state))

    @cached_property
    def panel(self) -> DataFrame:
        return P.observed_weeks(self.rolled)

    @cached_property
    def dim(self) -> DataFrame:
        """Ids and populations, stored."""
        return stage(P.place_dimension(self.populations, self.region_key, self.state))

    @cached_property
    def init(self) -> DataFrame:
        """Week-0 values, stored."""
        together(lambda: self.rolled, lambda: self.dim)
        return stage(P.initial_values(self.rolled, self.dim))
