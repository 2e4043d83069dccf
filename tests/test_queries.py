"""Every registered query against its SQL on the smallest tables, and plan checks."""
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return database(SF)


@pytest.mark.parametrize("name", queries())
def test_query(spark, duck, name):
    got = queries()[name](spark, SF).toPandas()
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        assert compare(got, duck.execute(sql).df()) == ""


def test_entry(spark):
    assert entry(spark).count() == 3


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_needs_one_exchange_and_reads_four_columns(spark):
    text = plan(queries()["W06_rolling_std"](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 1
    assert "props" not in text.split("ReadSchema")[1]


def test_filters_reach_the_scan(spark):
    text = plan(queries()["P10_time_range"](spark, SF))
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text


def test_interval_join_is_an_equi_join(spark):
    text = plan(queries()["J07_interval_join"](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text
