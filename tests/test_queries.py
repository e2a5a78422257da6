"""Every registered query of the engine against its SQL."""

import duckdb
import pandas as pd
import pytest

from lodestone import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL = queries.load()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
            return None
        return round(float(v), 6) if isinstance(v, float) else (bytes(v) if isinstance(v, bytearray) else v)

    return sorted(([value(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", [n for n, q in ALL.items() if q.sql])
def test_matches_sql(spark, oracle, name):
    got = ALL[name].run(spark, SF)
    want = oracle.sql(ALL[name].sql)
    columns = list(want.columns)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.limit(10**7).fetchall())


@pytest.mark.parametrize("name", [n for n, q in ALL.items() if not q.sql])
def test_runs(spark, name):
    assert ALL[name].run(spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
