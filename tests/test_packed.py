"""Packed draws: folds, the store, and the plans that follow from one row per draw."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epipanel import schemas
from epipanel.operators import draws as D
from epipanel.operators import intervals as I
from epipanel.operators import model_tables as M
from epipanel.operators import packed as P
from epipanel.operators import priors as R
from epipanel.plans.catalog import Frames
from epipanel.plans.quantities import Quantities
from epipanel.sources import readers, sinks

from conftest import DATA


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(values):
    return F.array(*[F.lit(v).cast("double") for v in values])


def test_folds(spark):
    assert one(spark, P.running_sums(array([1, 2.5, -1]))) == [1.0, 3.5, 2.5]
    assert one(spark, P.running_sums(array([1, None, 2]))) == [1.0, None, None]
    assert one(spark, P.running_sums(F.expr("cast(array() as array<double>)"))) == []
    assert one(spark, P.differences(array([4, 9, None, 3]))) == [None, 5.0, None, None]
    steps = array([1, 3, 7])
    assert [one(spark, P.in_force(steps, lambda s: s, F.lit(t))) for t in (0, 1, 2.5, 7, 99)] == [None, 1.0, 1.0, 7.0, 7.0]


def test_packing_keeps_every_entry(spark):
    rows = [(1, "p", 1, i, n, k, float(i + (k or 0))) for i in range(5) for n, k in (("a", None), ("b", 2), ("b", 1), ("b", 10))]
    long = spark.createDataFrame(rows, schemas.DRAWS).withColumn("value", F.when(F.col("idx").isNull() | (F.col("idx") != 2), F.col("value")))
    packed = P.pack_draws(long)
    assert packed.count() == 5
    assert [e["idx"] for e in packed.first()["entries"]] == [None, 1, 2, 10]
    assert sorted(map(str, P.unpack(packed).collect())) == sorted(map(str, long.collect()))
    assert P.pack_draws(long.where("false")).count() == 0


def test_wide_rows_are_packed_where_they_are(spark):
    wide = spark.createDataFrame(
        [(1, "p", 1, 1, 1.0, 2.0, 3.0, None)],
        "place_id int, source string, chain int, iteration int, `data_b[10]` double, `data_b[2]` double, a double, `data_b[1]` double",
    )
    packed = P.pack_wide(wide, D.DRAW_KEYS)
    assert [(e["name"], e["idx"], e["value"]) for e in packed.first()["entries"]] == [("a", None, 3.0), ("b", 1, None), ("b", 2, 2.0), ("b", 10, 1.0)]
    assert "Exchange" not in plan_of(packed)


def test_running_totals_stand_beside_their_series(spark):
    rows = [(1, "p", 1, 1, n, i, v) for n, vs in (("new_deaths", [1.0, 2.0, 4.0]), ("icu", [5.0, 5.0, 5.0])) for i, v in enumerate(vs, 1)]
    packed = P.pack_draws(spark.createDataFrame(rows, schemas.DRAWS))
    both = P.unpack(P.with_running_total(packed, "new_deaths", "total")).collect()
    assert sorted(r["value"] for r in both if r["name"] == "total") == [1.0, 3.0, 7.0] and len(both) == 9
    none = P.unpack(P.with_running_total(packed, "absent", "total", alone=True))
    assert none.count() == 0
    shuffled = spark.createDataFrame(rows[::-1], schemas.DRAWS).repartition(3)
    got = [r["value"] for r in I.cumulative_by_draw(shuffled).orderBy("idx").collect()]
    assert got == [1.0, 3.0, 7.0]


@pytest.fixture(scope="module")
def frames(spark):
    return Frames(spark, DATA)


def test_the_model_takes_one_exchange(frames):
    """Packing moves the three tables together; walks, changes, steps and flows add none."""
    centred = M.with_rates(frames.packed)
    for df in (M.log_random_walk(centred), M.increments(frames.packed), M.step_param_lookup(centred), M.transition_flows(centred)):
        plan = plan_of(df)
        assert plan.count("Exchange") == 1 and "Window" not in plan


def test_the_store_joins_nothing(spark, frames, tmp_path):
    """From the draw store all quantities of one source are told from a pruned scan."""
    sinks.write_store(frames.packed, f"{tmp_path}/store")
    stored = readers.read_store(spark, f"{tmp_path}/store", schemas.PACKED_MODEL)
    assert stored.count() == frames.data.draw_keys.count()
    mine = stored.where("source = 'posterior' and place_id = 3")
    plan = plan_of(mine)
    assert "PartitionFilters: [isnotnull(source" in plan and len(mine.inputFiles()) <= len(stored.inputFiles())
    model = Quantities(mine, frames.priors, frames.ingest.dim)
    rates = M.with_rates(M.centre_packed(model.packed, model.priors))
    plan = plan_of(M.transition_flows(rates))
    assert "SortMergeJoin" not in plan and "Window" not in plan
    want = Quantities(frames.packed, frames.priors, frames.ingest.dim).generated.where("source = 'posterior' and place_id = 3")
    assert sorted(map(str, model.generated.collect())) == sorted(map(str, want.collect()))


def test_replacing_a_place_leaves_the_others(spark, frames, tmp_path):
    path = f"{tmp_path}/store"
    sinks.write_store(frames.predicted, path)
    sinks.replace_places(frames.predicted.where("place_id = 1").limit(2), path)
    left = {r["place_id"]: r["count"] for r in readers.read_store(spark, path).groupBy("place_id").count().collect()}
    all_ = {r["place_id"]: r["count"] for r in frames.predicted.groupBy("place_id").count().collect()}
    assert left[1] < all_[1] and all(left[p] == all_[p] for p in (2, 3, 4, 5))


# ---------------------------------------------------------------- priors by place

def test_priors_fall_back_to_region_and_state(spark):
    dim = spark.createDataFrame([(1, "place", "A"), (2, "place", "B"), (3, "place", "C"), (4, "region", "X"), (5, "region", "Y"), (6, "state", "S")],
                                "id int, level string, place string")
    key = spark.createDataFrame([("X", "A"), ("X", "B"), ("Y", "C")], "region string, place string")
    fixed = spark.createDataFrame([("q", "exp", 0.0, 1.0), ("ϕ_icu", "exp", 9.0, 9.0)], schemas.PRIORS)
    fitted = spark.createDataFrame([(1, "ϕ_icu", "exp", 1.0, 0.1), (4, "ϕ_icu", "exp", 4.0, 0.4), (6, "ϕ_icu", "exp", 6.0, 0.6),
                                    (2, "ϕ_icu", "exp", None, 0.2), (6, "ϕ_cases", "exp", 60.0, 0.6)], "place_id int, " + schemas.PRIORS)
    got = {(r["place_id"], r["name"]): (r["mean"], r["level"]) for r in R.priors_by_place(fixed, fitted, dim, key).collect()}
    assert {p: got[p, "ϕ_icu"] for p in range(1, 7)} == {
        1: (1.0, "place"), 2: (4.0, "region"), 3: (6.0, "state"), 4: (4.0, "region"), 5: (6.0, "state"), 6: (6.0, "state")}
    assert all(got[p, "ϕ_cases"] == (60.0, "state") and got[p, "q"] == (0.0, "fixed") for p in range(1, 7)) and len(got) == 18
    unfitted = R.priors_by_place(fixed, fitted.where("false"), dim, key).collect()
    assert len(unfitted) == 12 and {r["level"] for r in unfitted} == {"fixed"}


def test_long_and_packed_centring_agree(spark, frames):
    long = M.centre_params(frames.data.parameters, frames.priors)
    packed = Quantities(frames.packed, frames.priors, frames.ingest.dim).centred
    columns = [*D.DRAW_KEYS, "name", F.round("value", 9).alias("value")]
    assert sorted(map(str, long.select(*columns).collect())) == sorted(map(str, packed.select(*columns).collect()))
    by_place = {(r["place_id"], r["name"]): r["mean"] for r in frames.priors.collect()}
    assert by_place[1, "ϕ_cases"] != by_place[2, "ϕ_cases"] and by_place[1, "IHR"] == by_place[2, "IHR"]
    with pytest.raises(Exception, match="no prior for"):
        M.centre_params(frames.data.parameters, frames.priors.where("name <> 'IHR'")).collect()
    with pytest.raises(Exception, match="no prior for"):
        M.centre_packed(frames.packed, frames.priors.where("name <> 'IHR'")).collect()


def test_dispersion_files_by_place(spark, tmp_path):
    moments = spark.createDataFrame([(1, "cases", 0.5, 0.1), (1, "icu", None, 0.2), (12, "cases", 0.75, 0.3)], schemas.DISPERSIONS)
    sinks.write_dispersions(moments, f"{tmp_path}/priors")
    assert sorted(map(str, readers.read_dispersions(spark, f"{tmp_path}/priors/*").collect())) == sorted(map(str, moments.collect()))
    flat = tmp_path / "flat"
    flat.mkdir()
    (flat / "overdisp_priors_countyid=7.csv").write_text("datastream,mean,sd\ncases,1.5,NA\n")
    (flat / "overdisp_priors_countyid=9.csv").write_text("sd,datastream,mean\n0.25,deaths,2\n")
    got = {tuple(r) for r in readers.read_dispersions(spark, str(flat)).collect()}
    assert got == {(7, "cases", 1.5, None), (9, "deaths", 2.0, 0.25)}


# ---------------------------------------------------------------- dense pivot

def test_many_names_pivot_in_one_list(spark):
    names = [f"n{i}" for i in range(5_000)]
    long = spark.range(20_000).selectExpr("id % 4 as k", "concat('n', cast(id % 5000 as string)) as name", "cast(id as double) as value")
    dense = D.long_to_dense(long.where("name <> 'n17'"), ["k"], names)
    got = {r["k"]: r["values"] for r in dense.collect()}
    assert len(got) == 4
    for k, values in got.items():
        want = [None] * 5_000
        for i in range(20_000):
            if i % 4 == k and i % 5000 != 17:
                want[i % 5000] = max(want[i % 5000] or 0.0, float(i))
        assert values == want
    assert plan_of(dense.select("k", "values")).count("ObjectHashAggregate") == 2


def test_pivot_of_repeated_missing_and_unknown_names(spark):
    rows = [(1, "a", 2.0), (1, "a", 5.0), (1, "zz", 9.0), (2, "b", None), (3, "zz", 1.0), (4, None, 1.0), (None, "a", 1.0)]
    got = D.long_to_wide(spark.createDataFrame(rows, "k int, name string, value double"), ["k"], ["a", "b"]).collect()
    assert {(r["k"], r["a"], r["b"]) for r in got} == {(1, 5.0, None), (2, None, None), (3, None, None), (4, None, None), (None, 1.0, None)}


# ---------------------------------------------------------------- likelihood dispersion

def test_dispersion_of_greatest_likelihood(spark):
    from math import lgamma, log

    rng = np.random.default_rng(8)
    rows = []
    for name, phi, n in (("low", 0.7, 60), ("mid", 6.0, 80), ("high", 90.0, 120)):
        mu = 40 + 30 * np.sin(np.arange(n) / 9)
        rows += [(name, t, float(v)) for t, v in enumerate(rng.negative_binomial(phi, phi / (phi + mu)))]
    rows += [("steady", t, 10.0) for t in range(30)] + [("gaps", t, None if t % 3 else float(t)) for t in range(30)] + [("zeros", t, 0.0) for t in range(9)]
    frame = spark.createDataFrame(rows, "name string, t int, value double")
    got = {r["name"]: r for r in R.nb_dispersion_ml(frame, ["name"], "t", "value").collect()}
    assert got["steady"]["phi"] is None and got["steady"]["log_likelihood"] is None and "zeros" not in got
    for name in ("low", "mid", "high", "gaps"):
        values = [v for m, _, v in rows if m == name and v is not None]
        around = [np.mean(values[max(0, i - 2) : i + 3]) for i in range(len(values))]
        weeks = [(k, m) for k, m in zip(values, around) if m > 0]

        def likelihood(phi):
            return sum(lgamma(k + phi) - lgamma(phi) - lgamma(k + 1) + phi * log(phi / (phi + m)) + k * log(m / (phi + m)) for k, m in weeks)

        if got[name]["phi"] is None:
            assert sum((k - m) ** 2 - k for k, m in weeks) <= 0
            continue
        grid = np.exp(np.linspace(-4, 12, 800))
        best = grid[int(np.argmax([likelihood(p) for p in grid]))]
        assert got[name]["n"] == len(weeks)
        assert abs(np.log(got[name]["phi"]) - np.log(best)) < 0.03
        assert got[name]["log_likelihood"] == pytest.approx(likelihood(got[name]["phi"]), abs=1e-6)
        assert got[name]["log_likelihood"] >= likelihood(best) - 1e-9


def test_digamma_and_trigamma(spark):
    from epipanel.functions.scalars import digamma, trigamma

    euler = 0.5772156649015329
    assert one(spark, digamma(F.lit(1.0))) == pytest.approx(-euler, abs=1e-11)
    assert one(spark, digamma(F.lit(0.5))) == pytest.approx(-euler - 2 * np.log(2), abs=1e-11)
    assert one(spark, trigamma(F.lit(1.0))) == pytest.approx(np.pi**2 / 6, abs=1e-11)
    assert one(spark, trigamma(F.lit(0.5))) == pytest.approx(np.pi**2 / 2, abs=1e-11)
    assert one(spark, digamma(F.lit(1e6))) == pytest.approx(np.log(1e6) - 0.5e-6, abs=1e-12)


def test_a_new_place_renumbers_none(spark):
    from epipanel.operators.panel import extend_dictionary

    start = spark.createDataFrame([(1, "place", "B"), (2, "state", "S")], "id int, level string, place string")
    seen = spark.createDataFrame([("place", "A"), ("place", "B"), ("place", "A"), ("region", None), ("state", "S")], "level string, place string")
    once = extend_dictionary(start, seen)
    assert {(r["id"], r["level"], r["place"]) for r in once.collect()} == {(1, "place", "B"), (2, "state", "S"), (3, "place", "A"), (4, "region", None)}
    assert extend_dictionary(once, seen).count() == 4
    assert extend_dictionary(start.where("false"), seen).count() == 4
