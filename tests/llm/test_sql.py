"""Queries of the training-data operators that SQL can express."""

import duckdb
import pytest

from cloneloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, data_dir, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data_dir}/documents.parquet'")
    got = queries.QUERIES[name](spark, data_dir).toPandas()
    want = con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: sorted(map(repr, df[columns].astype(object).values.tolist()))
    assert plain(got) == plain(want)
