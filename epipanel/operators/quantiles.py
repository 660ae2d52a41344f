"""Exact quantiles per group, one way for groups of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


OCTAVE = 16        # first-digit cells to a doubling of the value
FINER = 256        # cells that a cell is cut into by a later digit
FEW = 1024         # values of a cell that are gathered and sorted
_LOG_STEP = OCTAVE / math.log(2.0)
_ZERO = 1100 * OCTAVE      # the cells of positive values begin above it, mirrored by the negative ones
_NAN = 4 * _ZERO           # the cell of NaN, behind all others


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str = "quantiles"
) -> DataFrame:
    """``keys`` and ``out``: an array of linear-interpolation quantiles.

    Ranks are narrowed down digit by digit. The first digit of a value is its
    sign and logarithm, in ``OCTAVE`` cells to a doubling; its cells are
    counted for every group, with their least and greatest value, which
    combines map-side. Running counts tell the cells that hold a wanted rank.
    The values of these cells alone are read again: those of a cell of up to
    ``FEW`` are gathered and sorted, a larger cell is cut in ``FINER`` steps
    between its ends and its cells counted in turn. A cell whose ends are equal
    is answered. So the input is read once a digit, mostly twice in all, and no
    exchange carries it: one group that holds all rows costs a task no more
    than its cells, ties collapse, and nothing is stored but the few cells that
    are kept.

    Nulls are ignored. A group of nulls alone has null quantiles; a group that
    holds NaN, which has no rank, has NaN quantiles.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(c).alias(k) for k, c in zip(ks, keys)], F.col(value).cast("double").alias("_v")
    ).withColumn("_digit", F.expr(_FIRST_DIGIT))

    counted = rows.groupBy(*ks, "_digit").agg(
        F.expr("count(_v) AS _n"), F.expr("min(_v) AS _low"), F.expr("max(_v) AS _high")
    )
    group = ", ".join(ks)
    summed = counted.selectExpr(
        "*", f"coalesce({_SUM_BEFORE.format(group, '_digit')}, 0) AS _before",
        f"sum(_n) OVER (PARTITION BY {group}) AS _total",
        f"max(coalesce(_digit = {_NAN}, false)) OVER (PARTITION BY {group}) AS _nan",
    )
    # A group with nothing to rank keeps one row.
    kept = f"CASE WHEN _nan THEN _digit = {_NAN} ELSE _total = 0 OR size(_held) > 0 END"
    cells = stage(summed.withColumn("_held", F.expr(_held(probs))).where(kept))
    columns, answers = cells.columns, []
    while True:
        told = "transform(_held, r -> struct(r, _low AS v)) AS _told"
        answers.append(cells.where(f"NOT {_OPEN}").selectExpr(*ks, "_total", "_nan", told))
        few, more = cells.selectExpr(f"count_if({_OPEN} AND _n <= {FEW})", f"count_if({_OPEN} AND _n > {FEW})").first()
        if few:
            answers.append(_gathered(rows, cells.where(f"{_OPEN} AND _n <= {FEW}"), ks))
        if not more:
            break
        cells = stage(_refined(rows, cells.where(f"{_OPEN} AND _n > {FEW}"), ks, probs).select(*columns))

    found = reduce(DataFrame.union, answers).groupBy(*ks).agg(
        F.expr("first(_total) AS _total"), F.expr("max(_nan) AS _nan"),
        F.expr("map_from_entries(flatten(collect_list(_told))) AS _at"),
    )
    low, high = "bigint(floor(p * (_total - 1)))", "bigint(ceil(p * (_total - 1)))"
    asked = f"""transform({_probs(probs)}, p -> CASE
        WHEN _total = 0 THEN NULL WHEN _nan THEN double('NaN') WHEN {low} = {high} THEN element_at(_at, {low})
        ELSE ({high} - p * (_total - 1)) * element_at(_at, {low}) + (p * (_total - 1) - {low}) * element_at(_at, {high}) END)"""
    return found.select(*[F.col(k).alias(c) for k, c in zip(ks, keys)], F.expr(asked).alias(out))


# The expressions are SQL text: one call for each, where columns would take hundreds.

# Sign and logarithm of a value, never falling as the value rises; null for null. Infinity has a cell of its own.
_SIZE = f"int(floor(least(ln(abs(_v)), 720D) * {_LOG_STEP!r}D)) + {_ZERO}"
_FIRST_DIGIT = (
    f"CASE WHEN _v IS NULL THEN CAST(NULL AS INT) WHEN isnan(_v) THEN {_NAN} WHEN _v = 0 THEN 0 "
    f"WHEN _v > 0 THEN {_SIZE} ELSE -({_SIZE}) END"
)
_SUM_BEFORE = "sum(_n) OVER (PARTITION BY {} ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_OPEN = "coalesce(NOT _nan AND _low < _high, false)"


def _probs(probs: Sequence[float]) -> str:
    return "array(" + ", ".join(f"{float(p)!r}D" for p in probs) + ")"


def _held(probs: Sequence[float]) -> str:
    """The wanted ranks, 0-based and around each probability, that fall into a cell."""
    around = "array(bigint(floor(p * (_total - 1))), bigint(ceil(p * (_total - 1))))"
    ranks = f"array_distinct(flatten(transform({_probs(probs)}, p -> {around})))"
    return f"filter({ranks}, r -> r >= _before AND r < _before + _n)"


def _inside(rows: DataFrame, cells: DataFrame, ks: Sequence[str], *carried: str) -> DataFrame:
    """The rows whose value lies in one of ``cells``, with the cell's ends and other columns."""
    renamed = cells.selectExpr(
        *[f"{k} AS {k}_" for k in ks], "_digit AS _digit_", "_low AS _from", "_high AS _to", *carried
    )
    same = " AND ".join([*[f"{k} <=> {k}_" for k in ks], "_digit = _digit_", "_v BETWEEN _from AND _to"])
    return rows.join(renamed, F.expr(same))


def _gathered(rows: DataFrame, cells: DataFrame, ks: Sequence[str]) -> DataFrame:
    """The wanted ranks of small cells, from their sorted values."""
    inside = _inside(rows, cells, ks, "_before", "_total", "_held")
    sorted_ = inside.groupBy(*ks, "_digit", "_from", "_before", "_total", "_held").agg(F.expr("sort_array(collect_list(_v)) AS _all"))
    return sorted_.selectExpr(
        *ks, "_total", "false AS _nan", "transform(_held, r -> struct(r, get(_all, int(r - _before)) AS v)) AS _told"
    )


def _refined(rows: DataFrame, cells: DataFrame, ks: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The cells by one more digit that hold a wanted rank.

    A cell's least and greatest value fall apart, so every digit parts it.
    """
    inside = _inside(rows, cells, ks, "_before AS _base", "_total")
    cell = [*ks, "_digit", "_from"]
    counted = (
        inside.withColumn("_place", F.expr(f"int(floor((_v - _from) / (_to - _from) * {FINER}))"))
        .groupBy(*cell, "_base", "_total", "_place")
        .agg(F.expr("count(_v) AS _n"), F.expr("min(_v) AS _low"), F.expr("max(_v) AS _high"))
    )
    before = f"_base + coalesce({_SUM_BEFORE.format(', '.join(cell), '_place')}, 0) AS _before"
    summed = counted.selectExpr("*", before, "false AS _nan")
    return summed.withColumn("_held", F.expr(_held(probs))).where("size(_held) > 0")


def interval_probs(widths: Sequence[float]) -> list[float]:
    """0.5, then the lower and upper tail of each width."""
    tails = [p for w in widths for p in ((1.0 - w) / 2.0, 1.0 - (1.0 - w) / 2.0)]
    return [0.5, *tails]


def median_qi(df: DataFrame, keys: Sequence[str], value: str, widths: Sequence[float]) -> DataFrame:
    """Median and equal-tailed intervals, one row per group and width."""
    asked = group_quantiles(df, keys, value, interval_probs(widths), "_q")
    rows = ", ".join(
        f"struct({float(w)!r}D AS width, _q[{2 * i + 1}] AS lower, _q[0] AS value, _q[{2 * i + 2}] AS upper)"
        for i, w in enumerate(widths)
    )
    return asked.select(*keys, F.expr(f"inline(array({rows}))"))
