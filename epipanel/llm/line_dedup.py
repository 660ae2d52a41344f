"""Line deduplication by overlapping three-line windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .support import text_of

LINES = 3      # lines of a window


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for a row.

    Lambdas would otherwise repeat it for each of their elements.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def full(line: Column) -> Column:
    return F.rlike(line, F.lit(r"[^ \t\r]"))


def windows_of(lines: Column) -> Column:
    """(k, key) of every window over the non-blank lines; k counts those from 0."""

    def windows(x: Column) -> Column:
        starts = F.when(F.size(x) >= LINES, F.sequence(F.lit(0), F.size(x) - LINES)).otherwise(F.expr("array()"))
        return F.transform(
            starts,
            lambda k: F.struct(k.alias("k"), F.unhex(F.md5(F.array_join(F.slice(x, k + 1, LINES), "\n"))).alias("key")),
        )

    return let(F.filter(lines, full), windows)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_removed, text): every text without later occurrences of windows.

    Lines end at line feeds. Blank lines belong to no window and stay. A window
    is three lines in a row among the others, compared whole by a 128-bit
    digest. Of equal windows anywhere the first stays, by id, then by an MD5 of
    id and text (rows that share an id), then by position; one that overlaps the first in its own text is part of it. All
    others are later occurrences, and the lines that they cover are removed:
    their positions are merged to intervals and the text is put together from
    what lies between.

    Texts of fewer than three lines that are not blank, empty and null texts
    have no windows and stay as they are (null as empty). Rows that repeat both
    id and text are one document and get the same result; a null id comes
    first. Other columns, whatever their names, are not read. An empty table
    gives an empty result.
    """
    own = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), own.alias("own")).withColumn(
        "uid", F.unhex(F.md5(F.concat_ws("\n", "own", "text")))
    ).drop("own")
    lines = F.split("text", "\n", -1)
    windows = (
        rows.select("id", "uid", F.explode(windows_of(lines)).alias("w"))
        .select("id", "uid", "w.k", "w.key")
    )
    # One row per key leaves each task; a frequent window is merged there.
    repeated = (
        windows.groupBy("key").agg(F.min(F.struct("id", "uid", "k")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    # A frequent key is split by adaptive execution: its other side is one row.
    later = windows.join(repeated, "key").where(
        (F.col("uid") != F.col("first.uid")) | (F.col("k") >= F.col("first.k") + LINES)
    )
    order = Window.partitionBy("uid").orderBy("k")
    new = F.coalesce((F.col("k") > F.lag("k").over(order) + LINES).cast("int"), F.lit(1))
    intervals = (
        later.select("uid", "k").distinct()
        .withColumn("new", new).withColumn("island", F.sum("new").over(order))
        .groupBy("uid", "island").agg(F.min("k").alias("a"), (F.max("k") + LINES - 1).alias("b"))
        .groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("gone"))
    )
    return rows.join(intervals, "uid", "left").select(
        F.col("id").alias(id_col),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("gone", F.lit(0), lambda n, g: n + g["b"] - g["a"] + 1), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(without(lines, F.col("gone"))).alias("text"),
    )


def without(lines: Column, gone: Column) -> Column:
    """The text without intervals of its non-blank lines."""
    # 1-based places of the non-blank lines among all.
    places = F.filter(F.transform(lines, lambda x, i: F.when(full(x), i + 1)), lambda i: i.isNotNull())

    def weave(x: Column) -> Column:
        lines, places, gone = x["lines"], x["places"], x["gone"]

        def place(j: Column, side: str) -> Column:
            return F.element_at(places, F.element_at(gone, j)[side] + 1)

        # Between one interval's last line and the next one's first all lines
        # stay; inside an interval only the blank ones do.
        def between(j: Column) -> Column:
            after = F.when(j == 0, 0).otherwise(place(F.greatest(j, F.lit(1)), "b"))
            until = F.when(j == F.size(gone), F.size(lines) + 1).otherwise(place(F.least(j + 1, F.size(gone)), "a"))
            return F.slice(lines, after + 1, until - after - 1)

        def inside(j: Column) -> Column:
            return F.filter(F.slice(lines, place(j, "a"), place(j, "b") - place(j, "a") + 1), lambda y: ~full(y))

        steps = F.transform(
            F.sequence(F.lit(0), F.size(gone)),
            lambda j: F.when(j == 0, between(j)).otherwise(F.concat(inside(F.greatest(j, F.lit(1))), between(j))),
        )
        return F.array_join(F.flatten(steps), "\n")

    return let(F.struct(lines.alias("lines"), places.alias("places"), gone.alias("gone")), weave)


def report(cleaned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return cleaned.select(id_col, "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))
