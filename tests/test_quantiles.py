"""Exact quantiles against numpy, for groups in one range and over many."""

import numpy as np
import pytest

from epipanel.operators import quantiles as Q

PROBS = [0.0, 0.05, 0.15, 0.25, 0.5, 0.75, 0.85, 0.95, 1.0]


def frame(spark, groups):
    rows = [(k, None if k == "b" else 1, float(v)) for k, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "name string, idx int, value double")


def expected(groups):
    return {k: np.quantile(np.array(v, dtype=float), PROBS) for k, v in groups.items()}


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    return {
        "a": rng.normal(size=4000),                                   # a third of all rows
        "b": rng.poisson(5, size=3000),                               # ties, null key part
        "c": np.exp(rng.normal(0, 20, size=2500)),                    # very long tails
        "d": np.full(1500, 7.25),                                     # one value
        "e": rng.normal(size=40),                                     # usual size
        "f": np.concatenate([-np.exp(rng.normal(0, 9, 900)), [0.0] * 400]),
        "g": [3.0],
    }


def check(result, groups):
    got = {r["name"]: np.array(r["quantiles"]) for r in result.collect()}
    want = expected(groups)
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-12, atol=1e-300, err_msg=k)


@pytest.mark.parametrize("tasks", ["2", "8", "40"])
def test_every_size_agrees_with_numpy(spark, groups, tasks):
    """Few and many ranges: whole groups in one, and one group over many."""
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        check(Q.group_quantiles(frame(spark, groups), ["name", "idx"], "value", PROBS), groups)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_group_with_nearly_all_rows(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": np.round(rng.normal(size=60_000), 3), "b": [1.0, 2.0], "c": [5.0] * 7}
    check(Q.group_quantiles(frame(spark, groups).repartition(8), ["name", "idx"], "value", PROBS), groups)


def test_values_beyond_the_finite_range(spark):
    groups = {"x": [float("-inf")] * 30 + list(range(60)) + [float("inf")] * 31}
    df = frame(spark, groups)
    got = Q.group_quantiles(df, ["name", "idx"], "value", [0.0, 0.5, 1.0]).first()
    assert got["quantiles"][0] == float("-inf")
    assert got["quantiles"][1] == 30.0
    assert got["quantiles"][2] == float("inf")


def test_nulls_and_nan(spark):
    nan = float("nan")
    rows = [("a", 1.0), ("a", None), ("a", 2.0), ("b", None), ("b", None), ("c", 1.0), ("c", nan), ("c", 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "name string, value double")
    got = {r["name"]: r["quantiles"][0] for r in Q.group_quantiles(df, ["name"], "value", [0.5]).collect()}
    assert got["a"] == 1.5 and got["b"] is None and np.isnan(got["c"]) and got[None] == 4.0 and len(got) == 4


def rows_moved(spark, run):
    """The most rows that any stage of ``run`` writes to a shuffle."""
    context = spark.sparkContext
    store = context._jsc.sc().statusStore()

    def stages():
        none = context._gateway.new_array(context._jvm.double, 0)
        found = store.stageList(None, False, False, none, context._jvm.java.util.ArrayList())
        return {(found.apply(i).stageId(), found.apply(i).shuffleWriteRecords()) for i in range(found.size())}

    before = stages()
    run()
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return max(n for _, n in stages() - before)


def test_no_exchange_carries_the_rows(spark, tmp_path):
    """One group of 100,000 distinct values: what moves are cells and the values of a few of them."""
    spark.range(100_000).selectExpr("cast(rand(1) * 1000 + id * 1e-9 as double) as v", "'a' as k").write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    found = []
    moved = rows_moved(spark, lambda: found.extend(Q.group_quantiles(df, ["k"], "v", PROBS).collect()))
    values = [r["v"] for r in df.collect()]
    np.testing.assert_allclose(found[0]["quantiles"], np.quantile(values, PROBS), rtol=1e-12)
    assert moved < 20_000


def test_usual_groups_move_a_part(spark, tmp_path):
    """Groups of a thousand draws, as a model has them."""
    spark.range(64_000).selectExpr("id % 64 as k", "cast(randn(1) as double) as v").coalesce(1).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    moved = rows_moved(spark, lambda: Q.median_qi(df, ["k"], "v", (0.5, 0.7, 0.9)).collect())
    assert moved < 0.25 * 64_000


def test_digits_are_few(spark):
    """Usual draws take two readings, a group of any size a logarithm of its rows."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    for rows, most in ((1_000, 2), (30_000, 3)):
        reads.value = 0
        df = spark.range(rows).selectExpr("id % 2 as k", "sin(id) * id as v").mapInArrow(seen, "k long, v double")
        assert len(Q.group_quantiles(df, ["k"], "v", [0.1, 0.5]).collect()) == 2
        assert reads.value <= most * rows


def test_median_qi_rows_nest(spark, groups):
    got = Q.median_qi(frame(spark, groups), ["name", "idx"], "value", (0.5, 0.7, 0.9)).toPandas()
    assert len(got) == 3 * len(groups)
    assert (got.lower <= got.value).all() and (got.value <= got.upper).all()
    for _, g in got.groupby("name"):
        g = g.sort_values("width")
        assert g.lower.is_monotonic_decreasing and g.upper.is_monotonic_increasing
