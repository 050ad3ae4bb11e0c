"""Every registered query against its SQL twin, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import checks

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")

QUERIES = {name: check.run for name, check in checks.load().items()}
ORACLE = {name: check.sql for name, check in checks.load().items() if check.sql is not None}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return connection


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    result = db.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert canonical(df.columns, map(tuple, df.collect())) == canonical(names, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["ts_ms", "param_id", "value"]


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


def test_names():
    assert not [n for n in QUERIES if "pipeline" in n or n.startswith("op")]


def test_entry_lists_them():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
