"""Every registered query of the engine against its SQL, at sf0.01."""

from collections import Counter

import duckdb
import pytest

from codequarry import catalog_queries

SF = "/root/testdata/sf0.01"
SQL = catalog_queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "supplier", "nation", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got = catalog_queries.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(names)} FROM ({SQL[name]})").fetchall()
    assert want
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want)
