"""Each registered query against its SQL equivalent on the driver tables."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from registry.oracle import all_statements
from registry.queries import all_queries
from tests.conftest import TESTDATA

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, STATEMENTS = all_queries(), all_statements()


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def folder(request):
    path = os.path.join(TESTDATA, request.param)
    if not os.path.isdir(path):
        pytest.skip(f"no {path}")
    return path


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return connection


def _sortable(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, f"{value:.4f}")
    return (1, str(value))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: [_sortable(v) for v in row])


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_matches_sql(spark, duck, folder, name):
    frame = QUERIES[name](spark, folder)
    result = duck.execute(STATEMENTS[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    expected = _rows(columns, result.fetchall())
    actual = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    assert len(actual) == len(expected)
    for got, want in zip(actual, expected):
        for a, b in zip(got, want):
            if isinstance(b, float) and a is not None:
                assert not math.isnan(a) and a == pytest.approx(b, abs=1.5e-6)
            else:
                assert a == b


def test_every_statement_has_a_query():
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())
    assert set(STATEMENTS) <= set(QUERIES)
    assert set(QUERIES) - set(STATEMENTS) == {
        "velo_decay_fixed", "velo_decay_pitcher", "velo_decay_game", "velo_fitted",
    }


def test_entry(spark):
    assert entry(spark).count() > 0
