"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest
from compare import compare, open_duckdb

from hindcast.plans.oracle import oracle
from hindcast.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
STATEMENTS = oracle()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return open_duckdb(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, _seconds, _rows = compare(spark, con, name, QUERIES[name], STATEMENTS.get(name), FOLDER)
    assert problem is None


def test_requests_are_answered_from_the_first_tables_of_all(spark):
    purposes = {r["purpose"] for r in QUERIES["predict_requests_all"](spark, FOLDER).select("purpose").distinct().collect()}
    inspected = {n for n in ("customer", "lineitem", "nation", "orders", "part", "region", "supplier") if any(n in p for p in purposes)}
    assert inspected == {"customer", "lineitem", "nation"}


def test_every_query_has_sql():
    assert set(STATEMENTS) == set(QUERIES)
