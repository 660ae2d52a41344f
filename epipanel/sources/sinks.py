"""Writers of draws and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import MISSING

DRAW_PARTITIONS = ("source", "place_id")


def write_draws(df: DataFrame, path: str) -> None:
    """Draws as parquet, one folder per source and place, replacing the path.

    Rebalancing brings the rows of a place together and splits a place that is
    too large for one task into several files.
    """
    _partitioned(df).mode("overwrite").parquet(path)


def write_store(packed: DataFrame, path: str) -> None:
    """Packed draws, a row each, as the draw store: parquet by source and place, replacing the path.

    All of a draw stands in its row, so what joins parameters, steps and states
    elsewhere reads one scan of the store, and source and place prune it.
    """
    _partitioned(packed).mode("overwrite").parquet(path)


def replace_places(df: DataFrame, path: str) -> None:
    """Replace only the sources and places present in ``df``."""
    _partitioned(df).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _partitioned(df: DataFrame):
    return df.hint("rebalance", *DRAW_PARTITIONS).write.partitionBy(*DRAW_PARTITIONS)


def refresh_results(df: DataFrame, path: str) -> None:
    """Drop every earlier draw under ``path`` and store the new fit's."""
    write_draws(df, path)


MANIFEST = "_manifest"      # readers skip folders whose names begin so


def write_report(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """A CSV folder with header, in order of ``order`` or else in the frame's.

    A small report lands in one file because its partitions are coalesced at
    run time; a large one keeps several. With ``order`` (names of columns,
    ascending) a manifest is kept in the folder: each file's place in the order,
    its rows, and its first and last key. ``readers.read_report`` restores the
    order by it and opens only the files that a range of keys needs.
    """
    ordered = df.orderBy(*order) if order else df
    ordered.write.mode("overwrite").option("header", True).option("nullValue", MISSING).csv(path)
    if order:
        _manifest(df, path, order).write.mode("overwrite").json(f"{path}/{MANIFEST}")


def _manifest(df: DataFrame, path: str, order: Sequence[str]) -> DataFrame:
    """(file, rows, order, first, last) of each file; the writer names files in order of their parts."""
    spark, key = df.sparkSession, F.struct(*[F.col(c) for c in order])
    stored = spark.read.schema(df.schema).option("header", True).option("nullValue", MISSING).csv(path)
    return stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(list(order)).alias("order"), F.min(key).alias("first"), F.max(key).alias("last")
    )


def write_dispersions(moments: DataFrame, path: str) -> None:
    """Fitted dispersions (place_id, stream, mean, sd) as CSV files of their places, as other tools read them."""
    moments.select(
        F.col("place_id").alias("countyid"), F.col("stream").alias("datastream"), "mean", "sd"
    ).write.partitionBy("countyid").mode("overwrite").option("header", True).option("nullValue", MISSING).csv(path)
