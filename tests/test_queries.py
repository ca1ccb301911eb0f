"""Every registered query of the engine against its SQL twin, on the smallest tables."""

import duckdb
import pytest

from tracewell.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for name in "documents pages events orders lineitem conversations".split():
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    twin = sql.sql(catalog.ORACLE_SQL[name])
    assert sorted(twin.columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    want = sql.sql(f"SELECT {names} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
