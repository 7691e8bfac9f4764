import importlib

import duckdb
import pytest

import __spark_entry__ as entry

BASE = "/root/testdata/sf0.001"
CORE = sorted(importlib.import_module("foliant.plans.queries").QUERIES)


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in ("documents", "archives", "parts", "page_data", "web", "part_lines"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return c


def normal(rows):
    return sorted(tuple("NULL" if v is None else str(int(v)) if isinstance(v, (bool, int, float)) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", CORE)
def test_queries_match_their_sql(spark, sql, name):
    got = entry.queries()[name](spark, BASE)
    rows = normal(tuple(r[c] for c in sorted(got.columns)) for r in got.collect())
    text = entry.oracle_sql().get(name)
    if text is None:
        assert rows
        return
    expected = sql.execute(text)
    names = [d[0] for d in expected.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == sorted(got.columns)
    assert rows == normal(tuple(r[i] for i in order) for r in expected.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
