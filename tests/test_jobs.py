"""The jobs end to end on small files written by the test."""

import csv
import datetime as dt
import random

import numpy as np
import pytest

from epipanel.operators.panel import delay_ecdf
from epipanel.plans import jobs as J
from epipanel.sources import readers as R

COUNTIES = {"Al": ("X", 1000), "Bo": ("X", 2000), "Cy": ("Y", 3000)}
DAYS = 50
DRAWS = 40


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    rng = random.Random(5)
    first = dt.date(2022, 6, 1)

    def save(name, header, rows):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        with open(path, "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows([header, *rows])

    cases, census = [], []
    for place, (_, population) in COUNTIES.items():
        total = 0
        for d in range(DAYS):
            deaths = rng.randint(0, 2)
            total += deaths
            day = first + dt.timedelta(d)
            cases.append([day, place, "County", population, rng.randint(0, 30), deaths, total])
            census.append([place, day, rng.randint(1, 20), rng.randint(0, 5)])
    save("cases.csv", ["date", "area", "area_type", "population", "cases", "deaths", "cumulative_deaths"], cases)
    save("census.csv", ["county", "todays_date", "hospitalized_covid_confirmed_patients",
                        "icu_covid_confirmed_patients"], census)
    save("key.csv", ["region", "county"], [[r, p] for p, (r, _) in COUNTIES.items()])
    for source in J.SOURCES:
        for place in (1, 3):
            streams = ("new_cases", "new_deaths", "hospitalizations", "icu")
            names = [f"data_{s}[{i}]" for s in streams for i in (1, 2, 3)]
            save(f"results/{source}_predictive/{source}_predictive_county_id={place}.csv",
                 ["iteration", "chain", *names],
                 [[i, 1, *[rng.randint(0, 50) for _ in names]] for i in range(DRAWS)])
            names = ["σ_R₀", "IHR", "Rₜ_t[1]", "Rₜ_t[2]", "S[1]", "S[2]", "S[3]", "icu_mean[1]"]
            save(f"results/{source}_generated_quantities/{source}_gq_county_id={place}.csv",
                 ["iteration", "chain", *names],
                 [[i, 1, *[rng.random() for _ in names]] for i in range(DRAWS)])
    return root


def read(path):
    rows = []
    for part in sorted(path.glob("part-*.csv")):
        with open(part, newline="", encoding="utf-8") as f:
            rows += list(csv.DictReader(f))
    return rows


def test_jobs_from_feeds_to_export(spark, folder):
    events = spark.createDataFrame(
        [(s, d) for s in ("cases", "deaths") for d in (0, 1, 3)], "stream string, delay_days int"
    )
    data, results = str(folder / "data"), str(folder / "results")
    J.ingest(spark, str(folder / "cases.csv"), str(folder / "census.csv"), str(folder / "key.csv"),
             delay_ecdf(events), data)
    dim = read(folder / "data" / J.DIMENSION)
    assert [(r["id"], r["place"], r["population"]) for r in dim] == [
        ("1", "Al", "1000"), ("2", "Bo", "2000"), ("3", "Cy", "3000"),
        ("4", "X", "3000"), ("5", "Y", "3000"), ("6", "California", "6000"),
    ]
    panel = read(folder / "data" / J.PANEL)
    weeks = {int(r["time"]) for r in panel}
    assert 0 not in weeks and len(panel) == 6 * len(weeks)
    assert {r["place"] for r in panel} == {"Al", "Bo", "Cy", "X", "Y", "California"}

    J.tidy(spark, results, data)
    tidy = read(folder / "results" / "tidy_posterior_predictive")
    assert {r["name"] for r in tidy} == {"new_cases", "new_deaths", "hospitalizations", "icu", "cumulative_deaths"}
    ends = {int(r["time"]): r["end_date"] for r in panel}
    raw = []
    with open(folder / "results/posterior_predictive/posterior_predictive_county_id=3.csv", encoding="utf-8") as f:
        raw = list(csv.DictReader(f))
    totals = [sum(float(r[f"data_new_deaths[{i}]"]) for i in (1, 2)) for r in raw]
    row = next(r for r in tidy if (r["place"], r["name"], r["date"], r["width"]) == ("Cy", "cumulative_deaths", ends[2], "0.9"))
    assert float(row["lower"]) == pytest.approx(np.quantile(totals, 0.05))
    assert float(row["value"]) == pytest.approx(np.median(totals))

    J.export(spark, results, data, str(folder / "out"))
    rows = read(folder / "out" / J.EXPORT)
    assert [r["place"] for r in rows] == sorted(r["place"] for r in rows) and len(rows) == 2 * 3 * 3
    init = {r["place"]: float(r["D"]) for r in read(folder / "data" / J.INITIAL)}
    got = next(r for r in rows if (r["place"], r["date"], r["quantile"]) == ("Cy", ends[2], "0.5"))
    assert float(got["cumulative_deaths"]) == pytest.approx(np.median(totals) + init["Cy"])
    with_rt = [r for r in rows if r["Rt"] != "NA"]
    assert {r["date"] for r in with_rt} == {ends[1]} and len(with_rt) == 6

    tables = J.figure_tables(spark, results, data, str(folder / "key.csv"))
    assert {r["name"] for r in tables["scalars"].select("name").distinct().collect()} == {"sigma_R0", "IHR"}
    assert {r["name"] for r in tables["series"].select("name").distinct().collect()} == {"Rt_t", "S", "icu_mean"}
    assert {r["distribution"] for r in tables["predictive"].select("distribution").distinct().collect()} == set(J.SOURCES)
    head = {r["place"]: r for r in tables["headlines"].collect()}
    assert head["X"]["title"] == "X Region" and head["Cy"]["subtitle"] == f"Data Through {max(ends.values())}"
    assert tables["observed"].count() == 4 * len(panel)
    assert R.read_panel(spark, f"{data}/{J.PANEL}", place="place").count() == len(panel)


def test_jobs_leave_no_stages_and_clear_old_results(spark, folder, tmp_path):
    import os

    from epipanel.session import shared_folder

    scratch = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    gaps = spark.createDataFrame([(s, d) for s in ("cases", "deaths") for d in range(9)], "stream string, delay_days int")
    old = tmp_path / "results" / "tidy_prior_predictive"
    old.mkdir(parents=True)
    kept = tmp_path / "results" / "notes"
    kept.mkdir()
    J.ingest(spark, str(folder / "cases.csv"), str(folder / "census.csv"), str(folder / "key.csv"), delay_ecdf(gaps),
             str(tmp_path / "data"), results=str(tmp_path / "results"))
    assert not old.exists() and kept.exists()
    J.tidy(spark, str(folder / "results"), str(tmp_path / "data"))
    after = set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    assert not {x for x in after - before if "stage-" in x}
