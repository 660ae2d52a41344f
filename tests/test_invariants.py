"""Properties that hold whatever the data."""

from pyspark.sql import functions as F

from epipanel.operators import panel as P
from epipanel.plans.catalog import Frames

from conftest import DATA


def test_levels_add_up(spark):
    f = Frames(spark, DATA)
    totals = {
        r["level"]: r["population"]
        for r in f.ingest.dim.groupBy("level").agg(F.sum("population").alias("population")).collect()
    }
    assert totals["place"] == totals["region"] == totals["state"]
    summed = P.rollup_places(f.ingest.weekly, f.data.region_key, "All", align_dates=True)
    by_level = summed.groupBy("level", "time").agg(
        F.sum("hospitalized").alias("h"), F.sum("cumulative_deaths").alias("d"),
        P.sum_strict("cumulative_deaths").alias("whole"),
    ).collect()
    weeks = {r["time"] for r in by_level}
    for t in weeks:
        at = {r["level"]: r for r in by_level if r["time"] == t}
        assert at["place"]["h"] == at["region"]["h"] == at["state"]["h"]
        if at["place"]["whole"] is not None:
            assert at["place"]["d"] == at["region"]["d"] == at["state"]["d"]


def test_initial_values_remain(spark):
    f = Frames(spark, DATA)
    odd = f.ingest.init.where(
        F.col("remaining_population") != F.col("population") - (F.col("H") + F.col("ICU") + F.col("D"))
    )
    assert odd.count() == 0


def test_ecdf_is_monotone(spark):
    f = Frames(spark, DATA)
    for r in f.ingest.ecdf.groupBy("stream").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("x", "F"))), lambda s: s["F"]).alias("f")
    ).collect():
        assert r["f"] == sorted(r["f"]) and r["f"][0] == 0.0 and r["f"][-1] == 1.0


def test_intervals_nest(spark):
    f = Frames(spark, DATA)
    rows = f.predictive.toPandas()
    assert (rows.lower <= rows.value).all() and (rows.value <= rows.upper).all()


def test_stored_stages_are_scanned_by_column(spark):
    f = Frames(spark, DATA)
    plan = f.ingest.panel.select("place", "time")._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):]
    assert "est_cases" not in schema
    assert "GreaterThan" in plan or "Not(EqualTo(time,0))" in plan


def test_generated_quantities_read_each_input_once(spark):
    model = Frames(spark, DATA).model
    plan = model.generated._jdf.queryExecution().executedPlan().toString()
    # All of a draw stands in one stored row.
    assert "embeddings.parquet" not in plan and plan.count("FileScan parquet") == 2
    assert "Window" not in plan and "SortMergeJoin" not in plan
