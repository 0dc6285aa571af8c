import os

import pytest

from attesta.plans import fixtures, registry, tables

SF = "/root/testdata/sf0.001"


def rows(df):
    names = sorted(df.columns)

    def show(x):
        if x is None or x != x:
            return "null"
        return f"{x:.6f}" if isinstance(x, float) and x != int(x) else str(int(x)) if isinstance(x, float) else str(x)

    return names, sorted(tuple(show(r[c]) for c in names) for r in df.to_dict("records"))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    if os.path.isdir(SF):
        for t in os.listdir(SF):
            con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", fixtures.QUERIES)
def test_fixture_query(spark, duck, name):
    assert rows(registry.queries()[name](spark, SF).toPandas().astype(object)) == rows(duck.execute(registry.oracle_sql()[name]).df().astype(object))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", tables.QUERIES)
def test_table_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas().astype(object)
    assert len(got)
    if name in registry.oracle_sql():
        assert rows(got) == rows(duck.execute(registry.oracle_sql()[name]).df().astype(object))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
