"""Every query with SQL against DuckDB on the smallest tables; plans of a few."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from codeloom import conformance, fixtures, problems
from tools.compare import frame

NAMED = {**conformance.SQL, **fixtures.SQL, **problems.SQL}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(NAMED))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = E.queries()[name](spark, sf).toPandas(), duck.execute(NAMED[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert frame(got) == frame(want)


def test_entry(spark, sf):
    assert E.entry(spark).count() > 0


def test_filters_reach_the_scan(spark, sf):
    plan = conformance.q01_list_symbols(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,fn)" in plan and "EqualTo(language,python)" in plan
    narrow = conformance.a04_files_by_language(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<language:string>" in narrow


def test_core_does_not_import_the_subpackage():
    import pathlib
    import re

    for f in pathlib.Path(conformance.__file__).parent.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"^\s*(from|import) codeloom\.llm", f.read_text(), re.M), f
