import os

import duckdb
import pytest

from kelpie.plans.queries import QUERIES, SQL, flagship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        rows = lambda df: sorted(tuple(map(str, r)) for r in df[cols].itertuples(index=False, name=None))
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_flagship(spark):
    assert [r["rank"] for r in flagship(spark, SF).collect()] == list(range(1, 11))
