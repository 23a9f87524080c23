"""The driver contract: every registered query against its SQL counterpart."""

from __future__ import annotations

from collections import Counter

import __spark_entry__ as entry
import duckdb
import pytest
from deskmill.plans.catalog import CATALOG

TABLES = ("events", "documents", "conversations")


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_every_query_has_a_counterpart():
    assert set(CATALOG) <= set(entry.queries())
    assert set(CATALOG) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_equals_sql(spark, db, sf_dir, name):
    result = entry.queries()[name](spark, sf_dir)
    columns = sorted(result.columns)
    rows = Counter(tuple(r) for r in result.select(columns).collect())
    found = db.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    expected = Counter(found.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert rows == expected
