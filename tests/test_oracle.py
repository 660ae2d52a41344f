"""Every registered query against its SQL statement, and the plans they run as."""

import re

import pytest

import __spark_entry__ as entry
from epipanel.plans.catalog import QUERIES
from oracle.statements import STATEMENTS
from compare import connect, differences

from conftest import DATA



@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_matches_statement(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    assert differences(df, duck, STATEMENTS[name]) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|CartesianProduct|NestedLoop", plan)


def test_noise_covers_every_draw(spark):
    got = QUERIES["pad_params_randn"](spark, DATA)
    zeros = QUERIES["pad_params_zeros"](spark, DATA)
    assert got.count() == zeros.count()
    assert got.where("idx > 52 and value = 0").count() == 0


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {
        "place", "date", "quantile", "hosp_census_with_covid", "icu", "cases", "deaths",
        "cumulative_deaths", "Rt",
    }
    assert df.count() > 0
