"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from cloneloom import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (not isinstance(v, str) and pd.isna(v)):
        return None
    if isinstance(v, (str, bool)) or "bool" in str(type(v)):
        return v if isinstance(v, str) else bool(v)
    return int(v) if float(v).is_integer() else float(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def sql(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data_dir, sql, name):
    got = queries.QUERIES[name](spark, data_dir).toPandas()
    if name in queries.ORACLE_SQL:
        want = sql.execute(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
