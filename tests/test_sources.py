"""Readers and sinks, round trip."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from epipanel.operators import panel as P
from epipanel.sources import readers as R
from epipanel.sources import sinks as K

DRAW = "place_id int, source string, chain int, iteration int, name string, idx int, value double"


def draws(spark, places=(1, 2, 3), shift=0.0):
    rows = [
        (p, s, c, i, n, k, float(p * 100 + i) + shift)
        for p in places for s in ("prior", "posterior") for c in (1, 2) for i in range(5)
        for n, k in (("IHR", None), ("S", 1), ("S", 2))
    ]
    return spark.createDataFrame(rows, DRAW)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_draws_round_trip_and_prune(spark, tmp_path):
    path, df = str(tmp_path / "draws"), draws(spark)
    K.write_draws(df, path)
    back = R.read_draws(spark, path)
    assert same(back, df)
    plan = back.where("place_id = 2 and source = 'prior'")._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):].split("]")[0]
    assert "place_id" in filters and "source" in filters


def test_replacing_places_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "draws")
    K.write_draws(draws(spark), path)
    K.replace_places(draws(spark, places=(2,), shift=0.5), path)
    want = draws(spark, places=(1, 3)).unionByName(draws(spark, places=(2,), shift=0.5))
    assert same(R.read_draws(spark, path), want)
    K.refresh_results(draws(spark, places=(9,)), path)
    assert same(R.read_draws(spark, path), draws(spark, places=(9,)))


def test_scan_of_wide_files(spark, tmp_path):
    for place in (7, 28):
        (tmp_path / f"posterior_predictive_county_id={place}.csv").write_text(
            "iteration,chain,data_new_cases[1],data_new_cases[2],σ_R₀\n"
            f"1,1,{place}.5,2,0.1\n2,1,NA,4,0.2\n", encoding="utf-8"
        )
    got = R.scan_draw_dir(spark, str(tmp_path), "posterior")
    rows = {
        (r["place_id"], r["iteration"], r["name"], r["idx"]): r["value"] for r in got.collect()
    }
    assert len(rows) == 12
    assert rows[(28, 1, "new_cases", 1)] == 28.5 and rows[(7, 2, "new_cases", 1)] is None
    assert rows[(7, 2, "σ_R₀", None)] == 0.2


def test_files_have_their_own_columns(spark, tmp_path):
    (tmp_path / "a_county_id=1.csv").write_text("iteration,chain,x[1],y[1]\n1,1,1,2\n")
    (tmp_path / "b_county_id=2.csv").write_text("iteration,chain,y[1],x[1]\n1,1,2,1\n")
    (tmp_path / "c_county_id=3.csv").write_text("iteration,chain,x[1],x[2],y[1]\n1,1,1,5,2\n")
    got = {
        (r["place_id"], r["name"], r["idx"]): r["value"]
        for r in R.scan_draw_dir(spark, str(tmp_path), "prior").collect()
    }
    assert got == {(p, n, 1): v for p in (1, 2, 3) for n, v in (("x", 1.0), ("y", 2.0))} | {(3, "x", 2): 5.0}


def test_feed_parts_in_another_column_order(spark, tmp_path):
    (tmp_path / "1.csv").write_text(
        "county,todays_date,icu_covid_confirmed_patients,hospitalized_covid_confirmed_patients\nA,2022-06-01,2,8\n"
    )
    (tmp_path / "2.csv").write_text(
        "county,todays_date,hospitalized_covid_confirmed_patients,icu_covid_confirmed_patients\nB,2022-06-01,8,2\n"
    )
    rows = R.read_census(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and all((r["hospitalized"], r["icu"]) == (8.0, 2.0) for r in rows)


def test_wide_file_with_hundreds_of_columns(spark, tmp_path):
    n = 780
    header = ",".join(["iteration", "chain", *[f"S[{i}]" for i in range(1, n + 1)]])
    lines = [",".join([str(r), "1", *[str(r * 1000 + i) for i in range(1, n + 1)]]) for r in range(50)]
    (tmp_path / "gq_county_id=4.csv").write_text("\n".join([header, *lines]) + "\n")
    got = R.scan_draw_dir(spark, str(tmp_path), "posterior")
    check = got.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("value") == F.col("iteration") * 1000 + F.col("idx"), 1)).alias("right"),
    ).first()
    assert check["n"] == check["right"] == 50 * n


def test_feeds_are_read_by_name(spark, tmp_path):
    feed = tmp_path / "cases.csv"
    feed.write_text(
        "date,area,area_type,population,extra,deaths,cases,cumulative_deaths\n"
        "2022-06-01,Alameda,County,100,x,1,5,9\n"
        "2022-06-01,Unknown,County,,x,1,5,9\n"
        "2022-06-01,Out of state,County,,x,1,5,9\n"
        "2022-06-01,California,State,1000,x,1,5,9\n"
        "2022-06-02,Alameda,County,100,x,NA,5,9\n"
    )
    cleaned = R.read_place_daily(spark, str(feed))
    assert cleaned.count() == 2 and {r["place"] for r in cleaned.collect()} == {"Alameda"}
    daily = P.place_daily(cleaned).collect()
    assert [(r["date"], r["cases"], r["deaths"]) for r in daily] == [(dt.date(2022, 6, 1), 5.0, 1.0)]
    census = tmp_path / "census.csv"
    census.write_text(
        "county,todays_date,icu_covid_confirmed_patients,hospitalized_covid_confirmed_patients\n"
        "Alameda,2022-06-01,2,8\n"
    )
    row = R.read_census(spark, str(census)).first()
    assert (row["hospitalized"], row["icu"]) == (8.0, 2.0)


def test_dimension_files(spark, tmp_path):
    (tmp_path / "dim.csv").write_text("id,county,population\n1,Alameda,1685886\n")
    (tmp_path / "key.csv").write_text("region,county\nBay,Alameda\n")
    (tmp_path / "init.csv").write_text(
        "id,county,population,H,ICU,D,remaining_population\n1,Alameda,1685886,110,13,1898,1683865\n"
    )
    assert tuple(R.read_place_dim(spark, str(tmp_path / "dim.csv")).first()) == (1, "Alameda", 1685886)
    assert tuple(R.read_region_key(spark, str(tmp_path / "key.csv")).first()) == ("Bay", "Alameda")
    row = R.read_initial_values(spark, str(tmp_path / "init.csv")).first()
    paths = [str(tmp_path / f"{n}.csv") for n in ("dim", "key", "init")]
    assert [d.count() for d in R.read_dims(spark, *paths)] == [1, 1, 1]
    assert row["population"] - (row["H"] + row["ICU"] + row["D"]) == row["remaining_population"]


def test_report_keeps_order_and_missing(spark, tmp_path):
    path = str(tmp_path / "report")
    df = spark.createDataFrame(
        [("b", 2.0, None), ("a", 1.0, 0.5)], "place string, value double, Rt double"
    ).orderBy("place")
    K.write_report(df, path)
    back = R.read_named(spark, path, "place string, value double, Rt double")
    assert [tuple(r) for r in back.collect()] == [("a", 1.0, 0.5), ("b", 2.0, None)]


def test_intervals_under_other_names(spark, tmp_path):
    (tmp_path / "i.csv").write_text("county,name,date,value,.lower,.upper,.width,.point,.interval\nA,icu,2022-06-05,2,1,3,0.5,median,qi\n")
    row = R.read_intervals(spark, str(tmp_path / "i.csv"), R.INTERVAL_NAMES).first()
    assert (row["place"], row["lower"], row["value"], row["upper"], row["width"]) == ("A", 1.0, 2.0, 3.0, 0.5)


def test_a_report_is_read_in_order(spark, tmp_path):
    """From several files: the order is restored, a range opens only the files that hold it."""
    readers, sinks = R, K
    schema = "place string, time bigint, value double"
    rows = [(f"P{i % 7}", i // 7, None if i % 5 == 0 else float(i)) for i in range(700)] + [(None, 3, 1.5)]
    frame = spark.createDataFrame(rows, schema).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_report(frame, f"{tmp_path}/r", ["place", "time"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = list((tmp_path / "r").glob("part-*.csv"))
    assert len(files) > 2
    got = [tuple(r) for r in readers.read_report(spark, f"{tmp_path}/r", schema).collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    part = readers.read_report(spark, f"{tmp_path}/r", schema, first=["P2", 90], last=["P3"])
    assert [tuple(r) for r in part.collect()] == [r for r in got if r[0] and ("P2", 90) <= (r[0], r[1]) and r[0] <= "P3"]
    assert len(part.inputFiles()) < len(files)
    assert readers.read_report(spark, f"{tmp_path}/r", schema, first=["Z"]).count() == 0
    cut = next(f for f in files if f.read_text().count("\n") > 2)
    cut.write_text("place,time,value\n")
    (cut.parent / f".{cut.name}.crc").unlink()
    with pytest.raises(ValueError, match="manifest"):
        readers.read_report(spark, f"{tmp_path}/r", schema)
    sinks.write_report(frame.where("false"), f"{tmp_path}/none", ["place"])
    assert readers.read_report(spark, f"{tmp_path}/none", schema).count() == 0


def test_late_days_merge_into_the_panel(spark):
    first = dt.date(2022, 6, 1)
    days = [(p, first + dt.timedelta(d), None if (p, d) == ("B", 9) else float(d % 4), 1.0, d + 0.5, 2.5 if d % 2 else None, float(d), float(d % 3), None if d == 20 else 1.0)
            for p in "ABC" for d in range(21)]
    schema = "place string, date date, cases double, deaths double, est_cases double, est_deaths double, cumulative_deaths double, hospitalized double, icu double"
    frame, origin = spark.createDataFrame(days, schema), F.lit(first)
    key = spark.createDataFrame([("X", "A"), ("X", "B"), ("Y", "C")], "region string, place string")
    late = (F.col("place") == "B") & (F.col("date") >= F.lit(dt.date(2022, 6, 10)))
    before, added = P.panel_state(frame.where(~late), origin), P.panel_state(frame.where(late), origin)
    merged = P.merge_states(before, added)
    whole = P.weekly_panel(frame, origin)
    columns = sorted(whole.columns)
    assert sorted(map(str, P.panel_of(merged).select(*columns).collect())) == sorted(map(str, whole.select(*columns).collect()))
    rolled = P.rollup_places(P.panel_of(before), key, "S")
    updated = P.update_rollup(rolled, merged, added, key, "S")
    want = P.rollup_places(whole, key, "S")
    assert sorted(map(str, updated.collect())) == sorted(map(str, want.collect()))
    nothing = P.update_rollup(rolled, before, added.where("false"), key, "S")
    assert sorted(map(str, nothing.collect())) == sorted(map(str, rolled.collect()))
