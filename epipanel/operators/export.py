"""Export rows and the tables behind the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import EXPORT_LABELS, EXPORT_WIDTH
from .draws import long_to_wide, relabel, wide_to_long

RT = "Rₜ_t"


def filter_width(intervals: DataFrame, width: float) -> DataFrame:
    """Rows of one width; widths are compared as rounded numbers."""
    return intervals.where(F.round("width", 6) == F.lit(round(width, 6)))


def interval_to_quantile(intervals: DataFrame, width: float = EXPORT_WIDTH) -> DataFrame:
    """Each interval as its 0.5, lower and upper quantile rows."""
    tail = (1 - F.col("width")) / 2
    rows = F.array(
        F.struct(F.lit(0.5).alias("quantile"), F.col("value").alias("value")),
        F.struct(F.round(tail, 2).alias("quantile"), F.col("lower").alias("value")),
        F.struct(F.round(1 - tail, 2).alias("quantile"), F.col("upper").alias("value")),
    )
    kept = [c for c in intervals.columns if c not in ("width", "lower", "value", "upper")]
    return filter_width(intervals, width).select(*kept, F.inline(rows))


def export_rt(intervals: DataFrame, width: float = EXPORT_WIDTH) -> DataFrame:
    series = intervals.where((F.col("name") == RT) & F.col("date").isNotNull())
    return interval_to_quantile(series, width).select(
        "place", "date", "quantile", F.col("value").alias("Rt")
    )


def export_predictive(
    intervals: DataFrame, init: DataFrame, width: float = EXPORT_WIDTH
) -> DataFrame:
    """One row per place, date and quantile; cumulative deaths from the start."""
    rows = relabel(interval_to_quantile(intervals, width), "name", EXPORT_LABELS)
    wide = long_to_wide(rows, ["place", "date", "quantile"], list(EXPORT_LABELS.values()))
    seeded = wide.join(init.select("place", F.col("D").alias("_initial")), "place", "left")
    return seeded.withColumn(
        "cumulative_deaths", F.col("cumulative_new_deaths") + F.col("_initial")
    ).drop("cumulative_new_deaths", "_initial")


def forecast_export(
    predictive: DataFrame, generated: DataFrame, init: DataFrame, width: float = EXPORT_WIDTH
) -> DataFrame:
    """The published table: predicted streams with Rt, ordered by place id."""
    rows = export_predictive(predictive, init, width).join(
        export_rt(generated, width), ["place", "date", "quantile"], "left"
    )
    return order_by_dim(rows, init)


def order_by_dim(df: DataFrame, dim: DataFrame) -> DataFrame:
    ids = dim.select("place", F.col("id").alias("_id"))
    tail = [c for c in ("date", "quantile") if c in df.columns]
    return df.join(ids, "place", "left").orderBy("_id", *tail).drop("_id")


def place_type(places: DataFrame, region_key: DataFrame) -> DataFrame:
    """county, region or state, by membership in the region key."""
    counties = region_key.select("place").distinct().withColumn("_county", F.lit(True))
    regions = region_key.select(F.col("region").alias("place")).distinct().withColumn(
        "_region", F.lit(True)
    )
    kind = F.when(F.col("_county"), "county").when(F.col("_region"), "region").otherwise("state")
    return (
        places.select("place").distinct()
        .join(counties, "place", "left").join(regions, "place", "left")
        .select("place", kind.alias("place_type"))
    )


def observed_long(panel: DataFrame) -> DataFrame:
    """Observed streams under their predictive names, long."""
    wide = panel.select(
        "place",
        F.col("end_date").alias("date"),
        F.col("est_cases").alias("new_cases"),
        F.col("est_deaths").alias("new_deaths"),
        F.col("hospitalized").alias("hospitalizations"),
        "icu",
    )
    return wide_to_long(wide, ["place", "date"])


def headline(types: DataFrame, observed: DataFrame) -> DataFrame:
    """Figure title and subtitle of each place."""
    newest = observed.agg(F.max("date").cast("string").alias("d")).scalar()
    return types.select(
        "place",
        F.initcap(F.concat_ws(" ", "place", "place_type")).alias("title"),
        F.concat(F.lit("Data Through "), newest).alias("subtitle"),
    )
