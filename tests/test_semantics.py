"""Hand examples of results that a plain rewrite gets wrong."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epipanel.functions import scalars as S
from epipanel.operators import draws as D
from epipanel.operators import export as X
from epipanel.operators import horizon as H
from epipanel.operators import model_tables as M
from epipanel.operators import panel as P
from epipanel.operators.ranking import positions, top_n_finite

DAY = dt.date(2022, 6, 1)


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_sum_is_null_when_an_input_is(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "k string, v double")
    got = dict(df.groupBy("k").agg(S.sum_strict("v")).collect())
    assert got == {"a": None, "b": 2.0}


def test_last_keeps_a_null_at_the_newest_date(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None)], "t int, v double")
    assert df.agg(S.last_by("v", "t")).first()[0] is None


@pytest.mark.parametrize("x,want", [(2.5, 2.0), (3.5, 4.0), (-0.5, 0.0)])
def test_rounding_goes_to_even(spark, x, want):
    assert one(spark, S.half_even_round("x"), x=x) == want


def test_full_join_fills_census_only(spark):
    cases = spark.createDataFrame(
        [("a", DAY, 3.0, 0.0, 0.0)],
        "place string, date date, cases double, deaths double, cumulative_deaths double",
    )
    census = spark.createDataFrame(
        [("b", DAY, 2.0, 1.0)], "place string, date date, hospitalized double, icu double"
    )
    rows = {r["place"]: r for r in P.daily_full_join(cases, census).collect()}
    assert rows["a"]["hospitalized"] == 0.0 and rows["a"]["cases"] == 3.0
    assert rows["b"]["cases"] is None and rows["b"]["icu"] == 1.0


@pytest.mark.parametrize("latest", [DAY + dt.timedelta(days=n) for n in (0, 20, 83, 90)])
def test_window_is_whole_weeks(spark, latest):
    daily = spark.createDataFrame(
        [("a", latest, 1.0), ("a", latest + dt.timedelta(days=3), 0.0)],
        "place string, date date, hospitalized double",
    )
    row = P.reporting_window(daily).first()
    assert row["latest_date"] == latest
    assert ((row["last_date"] - row["first_date"]).days + 1) % 7 == 0


def test_ecdf_steps_and_ends(spark):
    events = spark.createDataFrame(
        [("cases", d) for d in (2, 2, 5, 6)], "stream string, delay_days int"
    )
    ecdf = P.delay_ecdf(events)
    assert [tuple(r) for r in ecdf.orderBy("x").select("x", "F").collect()] == [
        (1, 0.0), (2, 0.5), (3, 0.5), (4, 0.5), (5, 0.75), (6, 1.0)
    ]
    asked = spark.createDataFrame([(x,) for x in (-9, 1, 2, 4, 5, 6, 99)], "x int")
    got = dict(P.ecdf_lookup(asked, ecdf, "cases", "x", "f").collect())
    assert got == {-9: 0.0, 1: 0.0, 2: 0.5, 4: 0.5, 5: 0.75, 6: 1.0, 99: 1.0}


def test_zero_reported_share_gives_null(spark):
    events = spark.createDataFrame(
        [("cases", 3), ("deaths", 3)], "stream string, delay_days int"
    )
    daily = spark.createDataFrame(
        [("a", DAY, 4.0, 2.0)], "place string, date date, cases double, deaths double"
    )
    row = P.delay_correct(daily, F.lit(DAY), P.delay_ecdf(events)).first()
    assert row["est_cases"] is None and row["est_deaths"] == 2.0


def test_rollup_groups_by_week_bounds(spark):
    schema = (
        "place string, time bigint, start_date date, end_date date, cases double, deaths double, "
        "est_cases double, est_deaths double, cumulative_deaths double, hospitalized double, icu double"
    )
    later = DAY + dt.timedelta(days=1)
    end = DAY + dt.timedelta(days=6)
    panel = spark.createDataFrame(
        [
            ("a", 0, DAY, end, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
            ("b", 0, DAY, end, None, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0),
            ("c", 0, later, end, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0),
        ],
        schema,
    )
    key = spark.createDataFrame([("R", "a"), ("R", "b"), ("R", "c")], "region string, place string")
    apart = P.rollup_places(panel, key, "all").where("level = 'state'").collect()
    assert len(apart) == 2
    full = next(r for r in apart if r["start_date"] == DAY)
    assert full["cases"] is None and full["deaths"] == 3.0
    together = P.rollup_places(panel, key, "all", align_dates=True).where("level = 'state'").collect()
    assert len(together) == 1 and together[0]["deaths"] == 8.0
    assert together[0]["start_date"] == DAY and together[0]["cases"] is None


def test_dimension_and_initial_values(spark):
    pops = spark.createDataFrame(
        [("Bo", 10), ("Al", 20), ("Bo", 10), ("Cy", 30)], "place string, population bigint"
    )
    key = spark.createDataFrame([("X", "Al"), ("X", "Bo"), ("Y", "Cy")], "region string, place string")
    dim = P.place_dimension(pops, key, "All")
    got = [tuple(r) for r in dim.orderBy("id").select("id", "place", "population").collect()]
    assert got == [(1, "Al", 20), (2, "Bo", 10), (3, "Cy", 30), (4, "X", 30), (5, "Y", 30), (6, "All", 60)]
    day = dt.date(2022, 6, 1)
    panel = spark.createDataFrame(
        [("Al", 0, day + dt.timedelta(1), 7.0, 7.0, 7.0), ("Al", 0, day, 2.0, 1.0, 3.0), ("Al", 1, day, 9.0, 9.0, 9.0)],
        "place string, time bigint, start_date date, hospitalized double, icu double, cumulative_deaths double",
    ).withColumn("end_date", F.date_add("start_date", 6))
    (row,) = P.initial_values(panel, dim).collect()       # one row, that of the earliest start
    assert (row["H"], row["ICU"], row["D"], row["remaining_population"]) == (3.0, 2.0, 4.0, 11.0)


def test_quantile_labels_are_rounded_keys(spark):
    rows = spark.createDataFrame(
        [("a", 0.9, 1.0, 2.0, 3.0), ("a", 0.5, 1.5, 2.0, 2.5)],
        "place string, width double, lower double, value double, upper double",
    )
    got = dict(X.interval_to_quantile(rows).select("quantile", "value").collect())
    assert got == {0.5: 2.0, 0.05: 1.0, 0.95: 3.0}


def test_indexed_names(spark):
    df = spark.createDataFrame(
        [("data_new_cases[12]",), ("S[1]",), ("IHR",), ("icu_mean[3]",)], "name string"
    ).withColumn("raw", F.col("name"))
    parsed = D.align_time_index(D.parse_indexed_name(df))
    got = {r["raw"]: (r["name"], r["idx"], r["time"]) for r in parsed.collect()}
    assert got == {
        "data_new_cases[12]": ("new_cases", 12, 11),
        "S[1]": ("S", 1, 0),
        "IHR": ("IHR", None, None),
        "icu_mean[3]": ("icu_mean", 3, 3),
    }
    for raw, (name, idx, _) in got.items():
        assert D.split_name(raw) == (name, idx)


def test_record_round_trip(spark):
    df = spark.sql(
        "select 1 as draw, struct(0.5D as `σ_R₀`, array(1D, 2D, 3D) as S) as r union all "
        "select 2, struct(1.5D, array(4D, 5D))"
    )
    long = D.flatten_record(df, ["draw"], "r")
    named = long.withColumn("name", D.indexed_name())
    wide = D.long_to_wide(named, ["draw"], ["σ_R₀", "S[1]", "S[2]", "S[3]"])
    assert [tuple(r) for r in wide.orderBy("draw").collect()] == [
        (1, 0.5, 1.0, 2.0, 3.0), (2, 1.5, 4.0, 5.0, None)
    ]
    back = D.wide_to_long(wide, ["draw"], parse=True).where("value is not null")
    assert sorted(map(str, back.collect())) == sorted(map(str, long.collect()))


def test_calendar_and_horizon(spark):
    panel = spark.createDataFrame(
        [("a", 1, DAY, DAY + dt.timedelta(6), 1.0), ("a", 2, DAY + dt.timedelta(7), DAY + dt.timedelta(13), None)],
        "place string, time bigint, start_date date, end_date date, est_cases double",
    )
    got = [tuple(r) for r in H.forecast_calendar(panel, 2).orderBy("time").collect()]
    assert got == [(t, DAY + dt.timedelta(7 * t - 1)) for t in range(5)]
    ext = H.extend_horizon(panel, 2, ["est_cases"]).orderBy("time").collect()
    assert [r["time"] for r in ext] == [1, 2, 3, 4] and ext[-1]["est_cases"] is None
    mask = H.mask_observations(panel, 2, ["est_cases"]).collect()
    assert len(mask) == 4 and all(r["est_cases"] is None for r in mask)


def test_padding_modes(spark):
    draws = spark.createDataFrame(
        [(1, "posterior", 1, i, "z", 1, 0.5) for i in range(3000)],
        "place_id int, source string, chain int, iteration int, name string, idx int, value double",
    )
    new = spark.createDataFrame([("z", 2), ("s", None)], "name string, idx int")
    zeros = H.pad_params(draws, new, "zeros")
    assert zeros.count() == 9000 and zeros.where("value = 0").count() == 6000
    noise = H.pad_params(draws, new, "randn").where("idx is null or idx = 2")
    stats = noise.agg(F.avg("value"), F.stddev("value")).first()
    assert abs(stats[0]) < 0.05 and abs(stats[1] - 1) < 0.05
    again = H.pad_params(draws.repartition(5), new, "randn").where("idx is null or idx = 2")
    assert noise.exceptAll(again).count() == 0
    with pytest.raises(ValueError):
        H.pad_params(draws, new, "ones")


def test_chains_are_cut_to_the_shortest(spark):
    rows = [(c, i) for c, n in ((1, 10), (2, 7), (3, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "chain int, iteration int")
    got = D.truncate_chains(df, F.col("iteration") != 0, block=3).collect()
    assert {c: [r["iteration"] for r in sorted(got, key=lambda r: r["position"]) if r["chain"] == c]
            for c in (1, 2, 3)} == {c: [1, 2, 3, 4, 5, 6] for c in (1, 2, 3)}


def test_positions_across_blocks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1000).alias("o"))
    got = positions(df, ["k"], ["o"], F.floor(F.col("o") / 64)).toPandas()
    want = got.groupby("k")["o"].rank().astype(int)
    assert (got["position"] == want).all()


def test_top_n_drops_what_is_not_finite(spark):
    df = spark.createDataFrame(
        [(1, 1, float("nan")), (1, 2, float("inf")), (1, 3, 5.0), (1, 4, 7.0), (1, 5, 7.0), (1, 6, None)],
        "place int, seed int, lp double",
    )
    got = [(r["seed"], r["rank"]) for r in top_n_finite(df, ["place"], "lp", 2, "seed").collect()]
    assert got == [(4, 1), (5, 2)]


def test_names_missing_in_a_chain(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (2, "a", None), (1, "b", 1)], "chain int, name string, idx int"
    )
    assert [(r["name"], r["n_chains"]) for r in D.names_missing_in_chains(df).collect()] == [("b", 1)]
    parts = [df.where(f"chain = {c}").drop("chain") for c in (1, 2)]
    assert sorted(map(str, D.stack_chains(parts).select(df.columns).collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("x", [1e-10, 1e-3, 0.5, 1.0, 2.0, 7.9, 33.3, 1e3, 1e5])
def test_lgamma(spark, x):
    assert one(spark, S.lgamma("x"), x=x) == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-11)


def _log_density(k, mu, phi):
    """Product form in logs: exact to rounding for whole k, any dispersion."""
    rising = math.fsum(math.log1p(i / phi) for i in range(int(k)))
    return rising - math.lgamma(k + 1) + k * math.log(mu) - (k + phi) * math.log1p(mu / phi)


@pytest.mark.parametrize("phi", [1e-10, 0.01, 1.0, 7.99, 8.0, 250.0, 1e6, 1e10])
@pytest.mark.parametrize("k,mu", [(0.0, 1e-4), (3.0, 2.5), (1200.0, 900.0), (90000.0, 1e5)])
def test_log_density_at_extremes(spark, k, mu, phi):
    got = one(spark, S.nb_log_density("k", "mu", "phi"), k=k, mu=mu, phi=phi)
    assert got == pytest.approx(_log_density(k, mu, phi), rel=1e-9, abs=1e-6)


def packed_draw(spark, params, steps, states):
    """One packed draw: steps as {idx: value}, states as {t: {compartment: value}}."""
    from epipanel.constants import COMPARTMENTS
    from epipanel.schemas import PACKED_MODEL

    rows = [(t, *[float(s[c]) if s.get(c) is not None else None for c in COMPARTMENTS]) for t, s in states.items()]
    return spark.createDataFrame([(1, "posterior", 1, 1, params, list(steps.items()), rows)], PACKED_MODEL)


def test_flows_conserve_people(spark):
    sizes = dict(S=900, E=20, I=30, H=4, R=50, ICU=2, D=3)
    params = {"R₀_init": 3.4, "σ_R₀": 0.5, "γ": 0.6, "ν": 0.5, "η": 0.4, "κ": 0.05, "ω": 0.3, "IHR": 0.1, "HICUR": 0.2, "ICUDR": 0.25}
    row = M.transition_flows(packed_draw(spark, params, {}, {0: {**sizes, "C": 7}})).first().asDict()
    assert row["N"] == sum(sizes.values())
    assert row["infection"] == pytest.approx(3.4 * 0.5 * 30 * 900 / row["N"])
    moves = {       # what enters and leaves each compartment
        "S": (["waned_immunity"], ["infection"]), "E": (["infection"], ["progression"]),
        "I": (["progression"], ["hospitalization", "non_hospitalized_recovery"]),
        "H": (["hospitalization"], ["hospitalized_recovery", "icu_admission"]),
        "R": (["non_hospitalized_recovery", "hospitalized_recovery", "icu_recovery"], ["waned_immunity"]),
        "ICU": (["icu_admission"], ["icu_death", "icu_recovery"]), "D": (["icu_death"], []),
    }
    assert set(moves) == set(sizes)
    net = sum(sum(row[f] for f in entering) - sum(row[f] for f in leaving) for entering, leaving in moves.values())
    assert net == pytest.approx(0, abs=1e-9)


def test_steps_hold_until_the_next(spark):
    """Steps at weeks 1 and 3; the weeks between keep the β of the step before."""
    params = {"R₀_init": 1.0, "σ_R₀": 1.0, "ν": 2.0}
    draw = packed_draw(spark, params, {1: 1.0, 3: 1.0}, {t: {} for t in (0, 1, 2, 3, 9)})
    got = dict(M.step_param_lookup(draw).select("t", "value").collect())
    e = np.exp(1.0)
    assert got == pytest.approx({0: 2.0, 1: 2 * e, 2: 2 * e, 3: 2 * e * e, 9: 2 * e * e})


def test_first_week_has_no_increment(spark):
    draw = packed_draw(spark, {}, {}, {0: {"C": 1, "D": 1}, 1: {"C": 4, "D": 1}, 2: {"C": 9, "D": 3}})
    got = [(r["t"], r["new_C"], r["new_D"]) for r in M.increments(draw).orderBy("t").collect()]
    assert got == [(1, 3.0, 0.0), (2, 5.0, 2.0)]
    assert M.increments(packed_draw(spark, {}, {}, {})).count() == 0


def test_a_missing_step_ends_the_path(spark):
    params = {"R₀_init": 2.0, "σ_R₀": 0.5, "ν": 1.0}
    got = [r["R₀_t"] for r in M.log_random_walk(packed_draw(spark, params, {1: 0.5, 2: None, 3: 0.5}, {})).orderBy("idx").collect()]
    assert got[:2] == pytest.approx([2.0, 2.0 * np.exp(0.25)]) and got[2:] == [None, None]


def test_a_missing_mean_leaves_no_likelihood(spark):
    keys = "1 as place_id, 'p' as source, 1 as chain"
    observed = spark.sql("select 1 as place_id, s as stream, t, v as value from values ('a', 1, 3D), ('a', 2, 4D), ('a', 3, null) as x(s, t, v)")
    means = spark.sql(f"select {keys}, i as iteration, 'a' as stream, t, m as mu, 5D as phi from values (1, 1, 3D), (1, 2, null), (1, 3, null), (2, 1, 3D), (2, 2, 4D), (2, 3, null) as x(i, t, m)")
    got = {r["iteration"]: r for r in M.nb_loglik(observed, means).collect()}
    assert got[1]["log_likelihood"] is None and got[1]["n_observed"] == 2
    assert got[2]["log_likelihood"] < 0 and got[2]["n_observed"] == 2


def test_a_missing_day_has_no_share(spark):
    from epipanel.operators.panel import ecdf_lookup

    ecdf = spark.createDataFrame([("cases", 0, 0.25), ("cases", 1, 1.0)], "stream string, x int, F double")
    days = spark.createDataFrame([(-3,), (0,), (7,), (None,)], "d int")
    got = {r["d"]: r["f"] for r in ecdf_lookup(days, ecdf, "cases", "d", "f").collect()}
    assert got == {-3: 0.25, 0: 0.25, 7: 1.0, None: None}


def test_clamp_and_links(spark):
    assert one(spark, S.clamp("x", 1e-10, 1e10), x=1e12) == 1e10
    assert one(spark, S.logit(S.logistic("x")), x=-1.3) == pytest.approx(-1.3)


def test_missing_values_stay_missing(spark):
    from epipanel.functions.scalars import clamp
    from epipanel.operators import draws as D
    from epipanel.operators.intervals import cumulative_by_draw

    nan = float("nan")
    rows = spark.createDataFrame([(0, None), (1, nan), (2, -5.0), (3, 50.0), (4, 2.0)], "k int, x double")
    got = [r["y"] for r in rows.select("k", clamp("x", 0.0, 10.0).alias("y")).orderBy("k").collect()]
    assert got[0] is None and got[1] != got[1] and got[2:] == [0.0, 10.0, 2.0]

    series = spark.createDataFrame(
        [(1, "posterior", 1, 1, "new_deaths", i, v) for i, v in ((1, 1.0), (2, None), (3, 2.0))],
        "place_id int, source string, chain int, iteration int, name string, idx int, value double",
    )
    assert [r["value"] for r in cumulative_by_draw(series).orderBy("idx").collect()] == [1.0, None, None]

    chains = spark.createDataFrame([(c, i) for c in (1, 2) for i in range(5)], "chain int, iteration int")
    assert D.truncate_chains(chains, F.col("chain") == 1).count() == 0
