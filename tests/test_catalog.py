import duckdb
import pytest

from logweave import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    if name not in catalog.oracle_sql():
        assert got.count() > 0
        return
    expected = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    order = [names.index(c) for c in got.columns]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(r[i] for i in order) for r in expected.fetchall()), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
