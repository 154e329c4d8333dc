"""Every engine query against its SQL, on the small tables."""

import duckdb
import pytest

from verdigris.plans.oracle import sql
from verdigris.plans.queries import QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "part", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def test_each_query_has_sql():
    assert set(QUERIES) == set(sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    frame = QUERIES[name](spark, D)
    columns = sorted(frame.columns)
    cursor = con.execute(sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)
    want = sorted((tuple(dict(zip(names, r))[c] for c in columns) for r in cursor.fetchall()), key=str)
    assert got == want
