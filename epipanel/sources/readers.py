"""Readers of feeds, dimensions and draw folders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.draws import wide_to_long
from ..operators.packed import pack_wide
from ..operators.panel import clean_census_feed, clean_place_feed

# How a place id stands in the name of a draw file and of a file of dispersions.
PLACE_IN_PATH = r"county_id=(\d+)"
PLACE_IN_PRIORS = r"countyid=(\d+)"
# Fixed value: how a missing value is written in the CSV files.
MISSING = "NA"


def csv_parts(spark: SparkSession, path: str) -> list[DataFrame]:
    """The CSV files of a path, those of one header together, all columns as strings.

    Files of a folder may differ in their columns and in their order. Headers
    are found by a scan of the files' first blocks; their list has a row per file.
    """
    lines = (
        spark.read.text(path)
        .select("value", "_metadata.file_path", "_metadata.file_block_start")
        .where("file_block_start = 0").withColumn("at", F.monotonically_increasing_id())
    )
    first = lines.groupBy("file_path").agg(F.min_by("value", "at").alias("header")).collect()
    files: dict[str, list[str]] = {}
    for row in sorted(first):
        files.setdefault(row["header"].rstrip("\r"), []).append(unquote(row["file_path"]))
    return [
        spark.read.csv(paths, header=True, enforceSchema=False, nullValue=MISSING)
        for paths in files.values()
    ]


def read_named(
    spark: SparkSession, path: str, schema: str, renames: dict[str, str] | None = None
) -> DataFrame:
    """Columns of a CSV or parquet path by name, cast to a declared schema.

    ``renames`` maps a schema column to its name in the file. Columns the
    schema does not name are not read.
    """
    fields = T.StructType.fromDDL(schema).fields
    renames = renames or {}
    wanted = [
        F.col(f"`{renames.get(f.name, f.name)}`").cast(f.dataType).alias(f.name) for f in fields
    ]
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select(*wanted)
    parts = [part.select(*wanted) for part in csv_parts(spark, path)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def read_place_daily(spark: SparkSession, path: str) -> DataFrame:
    """County rows of the case and death feed."""
    return clean_place_feed(read_named(spark, path, schemas.PLACE_FEED))


def read_census(spark: SparkSession, path: str) -> DataFrame:
    return clean_census_feed(read_named(spark, path, schemas.CENSUS_FEED))


def read_place_dim(spark: SparkSession, path: str, place: str = "county") -> DataFrame:
    return read_named(spark, path, schemas.PLACE_DIM, {"place": place})


def read_region_key(spark: SparkSession, path: str, place: str = "county") -> DataFrame:
    return read_named(spark, path, schemas.PLACE_REGION, {"place": place})


def read_initial_values(spark: SparkSession, path: str, place: str = "county") -> DataFrame:
    return read_named(spark, path, schemas.INITIAL_VALUES, {"place": place})


def read_dims(
    spark: SparkSession, dim_path: str, region_key_path: str, initial_path: str,
    place: str = "county",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Place dimension, region key and initial values."""
    return (
        read_place_dim(spark, dim_path, place),
        read_region_key(spark, region_key_path, place),
        read_initial_values(spark, initial_path, place),
    )


def read_panel(spark: SparkSession, path: str, place: str = "county") -> DataFrame:
    return read_named(spark, path, schemas.WEEKLY_PANEL, {"place": place})


def read_report(
    spark: SparkSession, path: str, schema: str, first: Sequence | None = None, last: Sequence | None = None
) -> DataFrame:
    """A report that was written with an order, in that order.

    ``first`` and ``last`` bound the keys, both included; they may be shorter
    than the key, and files whose keys lie outside are not opened. Rows come
    in order of the key. A file that does not hold the rows that the manifest
    tells is an error.
    """
    told = spark.read.json(f"{path}/_manifest")
    if "order" not in told.columns:      # a report without rows
        return read_named(spark, path, schema)
    order = told.first()["order"]
    types = {f.name: f.dataType for f in T.StructType.fromDDL(schema).fields}

    def key(of: str | None, n: int) -> Column:
        return F.struct(*[F.col(f"{of}.{c}" if of else c).cast(types[c]).alias(c) for c in order[:n]])

    def bound(values: Sequence) -> Column:
        return F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, values)])

    wanted, inside = F.lit(True), F.lit(True)
    if first is not None:
        wanted = wanted & (key("last", len(first)) >= bound(first))
        inside = inside & (key(None, len(first)) >= bound(first))
    if last is not None:
        wanted = wanted & (key("first", len(last)) <= bound(last))
        inside = inside & (key(None, len(last)) <= bound(last))
    # A row for each file that is opened.
    files = {r["file"]: r["rows"] for r in told.where(wanted).select("file", "rows").collect()}
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([T.StructField(n, t) for n, t in types.items()])).option("header", True).option(
        "enforceSchema", False).option("nullValue", MISSING).csv([f"{path}/{f}" for f in files])
    found = {r["file"]: r["count"] for r in rows.groupBy(F.col("_metadata.file_name").alias("file")).count().collect()}
    if found != files:
        raise ValueError(f"{path} holds other rows than its manifest tells")
    return rows.where(inside).orderBy(*order)


DRAW_ID = ("place_id", "source", "chain", "iteration")


def scan_wide_parts(spark: SparkSession, path: str, source: str) -> list[DataFrame]:
    """The wide draw files of a folder, place id from the file name, a frame per header."""
    return [
        wide.withColumns(
            {
                "place_id": F.regexp_extract("_metadata.file_path", PLACE_IN_PATH, 1).cast("int"),
                "source": F.lit(source),
                "chain": F.col("chain").cast("int"),
                "iteration": F.col("iteration").cast("int"),
            }
        )
        for wide in csv_parts(spark, path)
    ]


def scan_draw_dir(spark: SparkSession, path: str, source: str) -> DataFrame:
    """All wide draw files of a folder as long draws; each file has its own columns."""
    parts = [wide_to_long(w, DRAW_ID, parse=True) for w in scan_wide_parts(spark, path, source)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schemas.DRAWS)


def scan_packed_dir(spark: SparkSession, path: str, source: str) -> DataFrame:
    """All wide draw files of a folder as packed draws: a line of a file is a draw, so nothing moves."""
    parts = [pack_wide(w, DRAW_ID) for w in scan_wide_parts(spark, path, source)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schemas.PACKED_DRAWS)


def read_dispersions(spark: SparkSession, path: str) -> DataFrame:
    """(place_id, stream, mean, sd) from the files of a folder; the place stands in each path, as countyid=N."""
    parts = [
        part.select(
            F.regexp_extract("_metadata.file_path", PLACE_IN_PRIORS, 1).cast("int").alias("place_id"),
            F.col("datastream").alias("stream"), F.col("mean").cast("double").alias("mean"), F.col("sd").cast("double").alias("sd"),
        )
        for part in csv_parts(spark, path)
    ]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schemas.DISPERSIONS)


def read_store(spark: SparkSession, path: str, schema: str = schemas.PACKED_DRAWS) -> DataFrame:
    """A draw store; source and place_id are partitions and prune the scan.

    ``schema`` may be ``schemas.PACKED_MODEL`` for a store of model draws.
    """
    return spark.read.schema(schema).parquet(path).select(*T.StructType.fromDDL(schema).names)


# Names of interval columns in reports that other tools write.
INTERVAL_NAMES = {"place": "county", "lower": ".lower", "upper": ".upper", "width": ".width"}


def read_intervals(
    spark: SparkSession, path: str, renames: dict[str, str] | None = None
) -> DataFrame:
    """Stored intervals; those of scalars have no date.

    ``renames=INTERVAL_NAMES`` reads reports with the names of other tools.
    """
    columns = spark.read.csv(path, header=True).columns
    schema = schemas.INTERVALS
    if "date" in columns:
        return read_named(spark, path, schema, renames)
    return read_named(spark, path, schema.replace("date date, ", ""), renames)


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    """Stored long draws; source and place_id are partitions and prune the scan."""
    return spark.read.schema(schemas.DRAWS).parquet(path).select(
        *T.StructType.fromDDL(schemas.DRAWS).names
    )
