"""The batch jobs, from files to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SCALAR_LABELS, VECTOR_LABELS
from ..operators import export as X
from ..operators import intervals as I
from ..operators import panel as P
from ..operators.draws import relabel, stack_sources
from ..operators.horizon import forecast_calendar
from ..operators.packed import unpack
from ..session import remove_folders, stage, stages_removed
from ..sources import readers as R
from ..sources.sinks import write_report, write_store
from .surveillance import Surveillance

# Names of the stored reports.
PANEL = "cases_hospitalizations_by_county"
INITIAL = "initialization_values"
DIMENSION = "county_id_pop"
EXPORT = "forecast_export"
SOURCES = ("prior", "posterior")


def ingest(
    spark: SparkSession,
    cases_path: str,
    census_path: str,
    region_key_path: str,
    ecdf: DataFrame,
    out: str,
    state: str = "California",
    results: str | None = None,
) -> None:
    """Feeds to the stored panel, initial values and place dimension.

    With ``results``, the draw folders and reports there are removed.
    """
    cleaned = R.read_place_daily(spark, cases_path)
    job = Surveillance(
        P.place_daily(cleaned),
        R.read_census(spark, census_path),
        R.read_region_key(spark, region_key_path),
        cleaned.select("place", "population"),
        None,
        state,
        ecdf=ecdf,
    )
    with stages_removed(spark):
        write_report(job.panel.drop("level").orderBy("place", "time"), f"{out}/{PANEL}")
        write_report(job.init.orderBy("id"), f"{out}/{INITIAL}")
        write_report(job.dim.drop("level").orderBy("id"), f"{out}/{DIMENSION}")
    if results is not None:
        # Results of an earlier panel no longer belong to this one.
        remove_folders(spark, [f"{results}/{name}" for name in result_folders()])


def result_folders() -> list[str]:
    """Draw folders, their store and the reports that follow from one panel."""
    return [STORE] + [
        f"{kind}{source}_{what}"
        for source in SOURCES
        for kind, what in (
            ("", "predictive"), ("", "generated_quantities"), ("tidy_", "predictive"),
            ("tidy_scalar_", "generated_quantities"), ("tidy_vector_", "generated_quantities"),
        )
    ]


STORE = "draw_store"
KINDS = ("predictive", "generated_quantities")


def store_draws(spark: SparkSession, results: str) -> None:
    """The draw folders as a draw store: a row per draw, by kind, source and place.

    The text files are parsed here once. A later fit of some places is added by
    ``sinks.replace_places``.
    """
    for kind in KINDS:
        both = [R.scan_packed_dir(spark, f"{results}/{source}_{kind}", source) for source in SOURCES]
        write_store(both[0].unionByName(both[1]), f"{results}/{STORE}/{kind}")


def tidy(spark: SparkSession, results: str, data: str) -> None:
    """Draw folders to interval reports: scalars, series and predictions per source."""
    store_draws(spark, results)
    with stages_removed(spark):
        _tidy(spark, results, data)


def _tidy(spark: SparkSession, results: str, data: str) -> None:
    calendar = stage(forecast_calendar(R.read_panel(spark, f"{data}/{PANEL}", place="place")))
    dim = stage(R.read_place_dim(spark, f"{data}/{DIMENSION}", place="place"))
    predicted, generated = (R.read_store(spark, f"{results}/{STORE}/{kind}") for kind in KINDS)

    def named(asked: DataFrame) -> DataFrame:
        return I.attach_place(asked, dim).drop("place_id")

    # Both sources are summarised together; the reports part them.
    asked = stage(named(I.gq_intervals(unpack(generated), calendar)))
    forecast = stage(named(I.predictive_intervals(predicted, calendar)))
    for source in SOURCES:
        mine = asked.where(F.col("source") == source).drop("source")
        scalars, series = I.scalar_vector_split(mine)
        write_report(
            scalars.orderBy("place", "name", "width"),
            f"{results}/tidy_scalar_{source}_generated_quantities",
        )
        write_report(
            series.orderBy("place", "name", "date", "width"),
            f"{results}/tidy_vector_{source}_generated_quantities",
        )
        write_report(
            forecast.where(F.col("source") == source).drop("source").orderBy("place", "name", "date", "width"),
            f"{results}/tidy_{source}_predictive",
        )


def export(spark: SparkSession, results: str, data: str, out: str) -> None:
    """Interval reports to the published forecast table."""
    rows = X.forecast_export(
        R.read_intervals(spark, f"{results}/tidy_posterior_predictive"),
        R.read_intervals(spark, f"{results}/tidy_vector_posterior_generated_quantities"),
        R.read_initial_values(spark, f"{data}/{INITIAL}", place="place"),
    )
    write_report(rows, f"{out}/{EXPORT}")


def figure_tables(
    spark: SparkSession, results: str, data: str, region_key_path: str
) -> dict[str, DataFrame]:
    """The tables the figures are drawn from."""
    panel = R.read_panel(spark, f"{data}/{PANEL}", place="place")
    observed = X.observed_long(panel)

    def both(stem: str) -> DataFrame:
        posterior, prior = (
            R.read_intervals(spark, f"{results}/{stem.format(s)}") for s in ("posterior", "prior")
        )
        return stack_sources(posterior, prior)

    types = X.place_type(panel, R.read_region_key(spark, region_key_path))
    return {
        "observed": observed,
        "predictive": both("tidy_{}_predictive"),
        "scalars": relabel(both("tidy_scalar_{}_generated_quantities"), "name", SCALAR_LABELS),
        "series": relabel(both("tidy_vector_{}_generated_quantities"), "name", VECTOR_LABELS),
        "headlines": X.headline(types, observed),
    }
