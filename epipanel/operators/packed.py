"""Draws as one row each: values by name, and series as arrays in order of weeks.

What a window does over the rows of a draw is a fold over its arrays here, so
sums, differences and values in force need no exchange once draws are packed.
A row's size is that of one draw and does not depend on their number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import COMPARTMENTS
from .draws import DRAW_KEYS, quoted, split_name

ENTRY = "array<struct<name:string,idx:int,value:double>>"
STATE = "struct<t:int," + ",".join(f"{c}:double" for c in COMPARTMENTS) + ">"


# ---------------------------------------------------------------- packing

def by_draw(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows dealt out by draw, over as many tasks as the session's shuffles or cores.

    Packing shrinks nothing before it moves, so this is its one exchange. The
    number is given, so that adaptive execution leaves few but dear rows spread.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def pack_draws(draws: DataFrame, keys: Sequence[str] = DRAW_KEYS) -> DataFrame:
    """Long draws to (keys, entries), entries in order of name and position; one exchange."""
    entry = F.struct("name", F.col("idx").cast("int").alias("idx"), F.col("value").cast("double").alias("value"))
    return by_draw(draws, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def pack_wide(df: DataFrame, keys: Sequence[str] = DRAW_KEYS, columns: Sequence[str] | None = None) -> DataFrame:
    """Wide draws to (keys, entries). A wide row is a draw already, so nothing moves.

    Column names are parsed while the plan is built. Entries stand in the
    order of their columns, those of a series in order of its positions.
    """
    columns = list(columns) if columns is not None else [c for c in df.columns if c not in keys]
    split = sorted(((*split_name(c), at) for at, c in enumerate(columns)), key=lambda s: (s[1] is not None, s[1] or 0, s[2]))
    values = F.array(*[F.col(quoted(columns[at])).cast("double") for *_, at in split])
    names = F.array(*[F.lit(name) for name, *_ in split])
    places = F.array(*[F.lit(idx).cast("int") for _, idx, _ in split])
    entries = F.transform(
        F.arrays_zip(names.alias("name"), places.alias("idx"), values.alias("value")),
        lambda e: F.struct(e["name"].alias("name"), e["idx"].alias("idx"), e["value"].alias("value")),
    )
    return df.select(*keys, entries.alias("entries"))


def unpack(packed: DataFrame, keys: Sequence[str] = DRAW_KEYS) -> DataFrame:
    """(keys, name, idx, value), a row per entry."""
    return packed.select(*keys, F.inline("entries"))


def pack_model(parameters: DataFrame, steps: DataFrame, states: DataFrame, keys: Sequence[str] = DRAW_KEYS) -> DataFrame:
    """(keys, params, steps, states) from three long tables, with one exchange for all of them.

    ``params`` maps names to values, ``steps`` are (idx, value) and ``states``
    (t, compartments), both in order. A draw that a table lacks has an empty
    map or array. A parameter that a draw has twice is an error.
    """
    state = F.struct(F.col("t").cast("int").alias("t"), *[F.col(c).cast("double").alias(c) for c in COMPARTMENTS])
    one = parameters.select(*keys, F.struct("name", F.col("value").cast("double").alias("value")).alias("_p"))
    two = steps.select(*keys, F.struct(F.col("idx").cast("int").alias("idx"), F.col("value").cast("double").alias("value")).alias("_s"))
    three = states.select(*keys, state.alias("_c"))
    stacked = one.unionByName(two, allowMissingColumns=True).unionByName(three, allowMissingColumns=True)
    # collect_list leaves the nulls of the other tables out.
    return by_draw(stacked, keys).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list("_p")).alias("params"),
        F.array_sort(F.collect_list("_s")).alias("steps"),
        F.array_sort(F.collect_list("_c")).alias("states"),
    )


# ---------------------------------------------------------------- folds over one draw

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(values: Column) -> Column:
    """Running totals of an array; missing from the first missing value on."""
    start = F.struct(F.lit(0.0).alias("total"), F.expr("cast(array() as array<double>)").alias("out"))

    def add(done: Column, x: Column) -> Column:
        total = done["total"] + x
        return F.struct(total.alias("total"), F.concat(done["out"], F.array(total)).alias("out"))

    return F.aggregate(values, start, add, lambda done: done["out"])


def differences(values: Column) -> Column:
    """Each value less the one before; the first has none."""
    return F.transform(values, lambda x, i: x - F.get(values, i - 1))


def in_force(steps: Column, at: Callable[[Column], Column], t: Column) -> Column:
    """The last of ordered ``steps`` whose time ``at`` is not after ``t``; null before the first."""
    return F.try_element_at(F.filter(steps, lambda s: at(s) <= t), F.lit(-1))


def series(entries: Column, name: str) -> Column:
    """The entries of one series, in order of positions."""
    return F.array_sort(F.filter(entries, lambda e: e["name"] == name))


def with_running_total(packed: DataFrame, name: str, out: str, alone: bool = False) -> DataFrame:
    """Adds the running total of one series to each draw's entries, or puts it in their place.

    It is missing from the first missing week on.
    """

    def total(one: Column) -> Column:
        return F.zip_with(
            one, running_sums(F.transform(one, lambda e: e["value"])),
            lambda e, v: F.struct(F.lit(out).alias("name"), e["idx"].alias("idx"), v.alias("value")),
        )

    added = let(series(F.col("entries"), name), total)
    return packed.withColumn("entries", added if alone else F.concat("entries", added))
