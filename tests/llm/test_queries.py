import duckdb
import pytest

from foliant.llm import queries

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in ("documents", "archives", "parts", "page_data", "containers", "mix_targets"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return c


# fill and shares need more texts than there are at this scale
@pytest.mark.parametrize("name", sorted(set(queries.SQL) - {"p6_containers", "p7_sources"}))
def test_queries_match_their_sql(spark, sql, name):
    got = queries.QUERIES[name](spark, BASE)
    expected = sql.execute(queries.SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted(str(tuple(r[c] for c in names)) for r in got.collect())
    assert rows == sorted(map(str, expected.fetchall()))
