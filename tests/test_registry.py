"""Registered queries against their SQL in another engine, on the smallest tables."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry

FOLDER = "/root/testdata/sf0.001"
TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
}


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def comparable(rows):
    return sorted(rows, key=lambda row: [(v is None, v if v is not None else 0) for v in row])


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, engine, name):
    df = registry.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    result = engine.execute(registry.oracle_sql()[name])
    types = {column[0]: str(column[1]) for column in result.description}
    order = list(types)
    assert {column: TYPES[kind] for column, kind in df.dtypes} == types
    expected = [tuple(row[order.index(n)] for n in names) for row in result.fetchall()]
    found = [tuple(row) for row in df.select(*names).collect()]
    assert comparable(found) == comparable(expected)


def test_sketched_tags_differ_little_from_exact_ones(spark):
    approx = registry.queries()["clv_tagged_approx"](spark, FOLDER)
    exact = registry.queries()["clv_tagged_exact"](spark, FOLDER)
    keys = ["restaurant_id", "customer_id", "date_key", "is_loyalty", "total_revenue", "clv_tag"]
    both = approx.select(*keys).intersect(exact.select(*keys)).count()
    assert approx.count() == exact.count()
    assert both / exact.count() > 0.97


def test_entry(spark):
    df = registry.entry(spark)
    assert "segment" in df.columns and df.count() > 0


def test_every_query_but_the_sketch_has_sql():
    own = {n for n in registry.queries() if not re.fullmatch(r"pipeline|op\d+_\w+", n)}
    assert own - set(registry.oracle_sql()) == {"clv_tagged_approx"}
