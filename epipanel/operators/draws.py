"""Shape of draw tables: wide and long, names and positions, chains."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import INDEXED, PREDICTIVE_PREFIX, base_of, index_of
from .ranking import positions

DRAW_KEYS = ("place_id", "source", "chain", "iteration")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_array(items) -> Column:
    """One array expression for any number of columns or literals."""
    return F.expr("array(" + ", ".join(items) + ")")


def split_name(name: str) -> tuple[str, int | None]:
    """(base, position) of a column name; position is None for a scalar."""
    found = re.match(INDEXED, name)
    if not found:
        return name, None
    return re.sub(PREDICTIVE_PREFIX, "", found.group(1)), int(found.group(2))


def wide_to_long(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    prefix: str | None = None,
    parse: bool = False,
) -> DataFrame:
    """Unpivot to (keys, name, value), or (keys, name, idx, value) with ``parse``.

    Parsing splits the column names while the plan is built, so no row is
    matched against a pattern. Each row becomes one array and is exploded
    against a constant array of names, which stays compact for many hundreds
    of columns.
    """
    columns = list(columns) if columns is not None else [c for c in df.columns if c not in keys]
    if prefix is not None:
        columns = [c for c in columns if c.startswith(prefix)]
    split = [split_name(c) if parse else (c, None) for c in columns]
    values = _sql_array(f"CAST({quoted(c)} AS DOUBLE)" for c in columns)
    names = _sql_array(_literal(n) for n, _ in split)
    rows = df.select(*keys, F.posexplode(values).alias("_at", "value"))
    out = [*keys, F.element_at(names, F.col("_at") + 1).alias("name")]
    if parse:
        places = _sql_array("CAST(NULL AS INT)" if i is None else str(i) for _, i in split)
        out.append(F.element_at(places, F.col("_at") + 1).alias("idx"))
    return rows.select(*out, "value")


def long_to_dense(
    df: DataFrame,
    keys: Sequence[str],
    names: Sequence[str],
    name: str = "name",
    value: str = "value",
    out: str = "values",
) -> DataFrame:
    """``keys`` and one array with a place for each listed name, in their order.

    Names become positions, and one list is gathered for each key, whatever
    the number of names; a key's list is as long as its values are many. A name
    that a key lacks is null, one that it has several times is its greatest
    value. Other names are left out, but their keys stay.
    """
    position = F.try_element_at(_positions(names), F.col(name))
    entry = F.when(position.isNotNull(), F.struct(position.alias("at"), F.col(value).cast("double").alias("v")))
    gathered = df.select(*keys, entry.alias("_e")).groupBy(*keys).agg(F.collect_list("_e").alias("_e"))
    # Every position once more without a value, so that none is missing.
    blank = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.struct(i.alias("at"), F.lit(None).cast("double").alias("v")))
    ordered = F.array_sort(F.concat("_e", blank))

    def last_of_each(all_: Column) -> Column:
        # Of one position nulls sort first and the greatest value last.
        kept = F.filter(all_, lambda e, i: (i == F.size(all_) - 1) | (F.get(all_, i + 1)["at"] != e["at"]))
        return F.transform(kept, lambda e: e["v"])

    return gathered.select(*keys, F.element_at(F.transform(F.array(ordered), last_of_each), 1).alias(out))


def _positions(names: Sequence[str]) -> Column:
    """A constant map of names to positions."""
    return F.map_from_arrays(_sql_array(_literal(n) for n in names), F.sequence(F.lit(0), F.lit(len(names) - 1)))


def dense_to_wide(df: DataFrame, keys: Sequence[str], names: Sequence[str], values: str = "values") -> DataFrame:
    """One column for each place of a dense array; for sinks, and for operators that name columns."""
    return df.select(*keys, *[F.get(values, F.lit(i)).alias(n) for i, n in enumerate(names)])


def long_to_wide(
    df: DataFrame,
    keys: Sequence[str],
    names: Sequence[str],
    name: str = "name",
    value: str = "value",
) -> DataFrame:
    """One column per listed name. The list is given, so no job looks for it."""
    return dense_to_wide(long_to_dense(df, keys, names, name, value), keys, names)


def parse_indexed_name(df: DataFrame, name: str = "name") -> DataFrame:
    """Split ``name[i]`` strings held in a column into name and idx."""
    return df.withColumn("idx", index_of(name)).withColumn(name, base_of(name))


def indexed_name(name: Column | str = "name", idx: Column | str = "idx") -> Column:
    name = F.col(name) if isinstance(name, str) else name
    idx = F.col(idx) if isinstance(idx, str) else idx
    return F.when(idx.isNull(), name).otherwise(F.format_string("%s[%d]", name, idx))


def align_time_index(df: DataFrame, out: str = "time") -> DataFrame:
    """Week of each position: means start at week 1, all else at week 0."""
    shift = F.when(F.col("name").endswith("_mean"), 0).otherwise(1)
    return df.withColumn(out, (F.col("idx") - shift).cast("bigint"))


def flatten_record(df: DataFrame, keys: Sequence[str], record: str) -> DataFrame:
    """A struct of numbers and number arrays as (keys, name, idx, value) rows.

    Arrays are numbered from 1; numbers have a null position. One pass, no
    shuffle, whatever the length of the arrays.
    """
    def entry(name: str, idx: Column, value: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            idx.cast("int").alias("idx"),
            value.cast("double").alias("value"),
        )

    def rows(field: T.StructField) -> Column:
        c = F.col(f"{record}.{quoted(field.name)}")
        if isinstance(field.dataType, T.ArrayType):
            return F.transform(c, lambda x, i: entry(field.name, i + 1, x))
        return F.array(entry(field.name, F.lit(None), c))

    fields = df.schema[record].dataType.fields
    return df.select(*keys, F.inline(F.concat(*[rows(f) for f in fields])))


def reorder_vars(df: DataFrame, order: DataFrame) -> DataFrame:
    """Attach each variable's place in a (name, idx, pos) list; others fall out."""
    left, right = df.alias("l"), order.select("name", "idx", "pos").alias("r")
    on = (F.col("l.name") == F.col("r.name")) & F.col("l.idx").eqNullSafe(F.col("r.idx"))
    return left.join(right, on).select("l.*", "r.pos")


def new_names(wider: DataFrame, narrower: DataFrame) -> DataFrame:
    """Distinct (name, idx) of the first table that the second lacks."""
    left = wider.select("name", "idx").distinct().alias("l")
    right = narrower.select("name", "idx").distinct().alias("r")
    on = (F.col("l.name") == F.col("r.name")) & F.col("l.idx").eqNullSafe(F.col("r.idx"))
    return left.join(right, on, "left_anti").select("l.name", "l.idx")


def stack_chains(chains: Sequence[DataFrame]) -> DataFrame:
    """Draws of several chains under one another, numbered from 1."""
    first, *rest = [c.withColumn("chain", F.lit(i)) for i, c in enumerate(chains, start=1)]
    for c in rest:
        first = first.unionByName(c)
    return first


def names_missing_in_chains(draws: DataFrame) -> DataFrame:
    """Names that some chain lacks; empty when all chains can be stacked."""
    seen = draws.select("chain", "name", "idx").distinct()
    chains = draws.agg(F.count_distinct("chain").alias("n")).scalar()
    return (
        seen.groupBy("name", "idx").agg(F.count(F.lit(1)).alias("n_chains"))
        .where(F.col("n_chains") < chains)
    )


def truncate_chains(
    draws: DataFrame,
    keep: Column,
    keys: Sequence[str] = ("chain",),
    iteration: str = "iteration",
    block: int = 4096,
) -> DataFrame:
    """Kept draws, each chain cut to the shortest kept chain.

    A chain that keeps no draw has length 0, so its group keeps none.
    ``draws`` holds one row per draw. Positions are counted in blocks of
    iterations, so a long chain is not one task's work.
    """
    kept = draws.where(keep)
    outer = [k for k in keys if k != "chain"]
    lengths = draws.groupBy(*keys).agg(F.count_if(keep).alias("_n"))
    shortest = lengths.groupBy(*outer).agg(F.min("_n").alias("_shortest"))
    placed = positions(
        kept, keys, [iteration], F.floor(F.col(iteration) / F.lit(block)), out="position"
    )
    if outer:
        return (
            placed.join(shortest, outer)
            .where(F.col("position") <= F.col("_shortest")).drop("_shortest")
        )
    return placed.where(F.col("position") <= shortest.scalar())


def relabel(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace listed values; the rest stay as they are."""
    return df.replace(dict(mapping), subset=[column])


def exclude_names(df: DataFrame, names: Sequence[str], column: str = "name") -> DataFrame:
    return df.where(~F.col(column).isin(*names))


def derive_totals(df: DataFrame, totals: Mapping[str, Sequence[str]]) -> DataFrame:
    """Row-wise sums of columns."""
    def total(parts: Sequence[str]) -> Column:
        first, *rest = [F.col(p) for p in parts]
        for p in rest:
            first = first + p
        return first

    return df.withColumns({name: total(parts) for name, parts in totals.items()})


def derive_totals_long(
    df: DataFrame,
    keys: Sequence[str],
    totals: Mapping[str, Sequence[str]],
    excluded: Sequence[str],
    since=None,
    others: Sequence[str] = (),
) -> DataFrame:
    """Long → wide → totals → long, without the excluded names, from a date on.

    ``others`` are names that belong to no total and are carried along.
    """
    parts = sorted({p for pair in totals.values() for p in pair}) + list(others)
    df = df if since is None else df.where(F.col("date") >= F.lit(since).cast("date"))
    wide = derive_totals(long_to_wide(df, keys, parts), totals)
    return exclude_names(wide_to_long(wide, keys, [*parts, *totals]), excluded)


def stack_sources(posterior: DataFrame, prior: DataFrame, out: str = "distribution") -> DataFrame:
    return posterior.withColumn(out, F.lit("posterior")).unionByName(
        prior.withColumn(out, F.lit("prior")), allowMissingColumns=True
    )
