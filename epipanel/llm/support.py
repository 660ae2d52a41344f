"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

__all__ = ["ascii_lower", "components", "released", "small_batches", "stage", "table", "text_of", "text_parts"]

BATCH_ROWS = 512       # rows that go to a Python worker at once, if the session does not say

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(name: str) -> Column:
    """The whole text of a column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text of single-byte characters takes the fast path."""
    single = F.length(text) == F.octet_length(text)
    return F.when(single, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that sends texts to Python workers some hundred at a time.

    An Arrow batch is held on both sides of the pipe, and Spark's default of
    10,000 rows is meant for numbers. A setting other than the default stays.
    """
    name, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)
    return df


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; Arrow's spare memory is given back behind the last one, as workers live on."""
    yield from batches
    pa.default_memory_pool().release_unused()


def text_parts(column: pa.Array, most: int) -> Iterator[list[bytes]]:
    """The texts of a binary column, null as empty, in lists of ``most`` bytes or little more than one text."""
    texts, size = [], 0
    for text in column:
        texts.append(text.as_py() or b"")
        size += len(texts[-1])
        if size >= most:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest id reachable from each id by undirected links: (id, component).

    A round is two linear steps: every id sends its larger neighbours to the
    smallest of its neighbourhood, then its smaller ones. Rounds go on until no
    link changes; the links then are one star per component. It takes about the
    logarithm of the longest chain. Each round is written to the shared folder;
    links never reach the driver, and no id ever lists its neighbours.
    """
    edges = stage(
        links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where("hi <> lo").distinct()
    )
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            edges.select(F.col("lo"), F.col("hi"))
        )
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(near, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .where("hi <> lo").distinct()
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = large.join(least, "hi").select("m", F.explode(F.array("hi", "lo")).alias("hi"))
        edges = stage(pairs.select("hi", F.col("m").alias("lo")).where("hi <> lo").distinct())
        before, state = state, _state(edges)
        if before == state:      # as many links, with the same checksum
            break
    roots = edges.select(F.col("lo").alias("id")).distinct()
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(
        roots.select("id", F.col("id").alias("component"))
    )


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0))).first()
    return row[0], row[1]
