"""Every query that has SQL against DuckDB, and the rest for rows and a stable schema."""

import duckdb
import pytest

from webloom.plans import ORACLE_SQL, QUERIES

TABLES = "customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    clean = lambda x: round(x, 6) if isinstance(x, float) else x
    a = sorted([tuple(clean(r[c]) for c in sorted(names)) for r in got.collect()], key=str)
    b = sorted([tuple(clean(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in want.fetchall()], key=str)
    assert a == b


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
