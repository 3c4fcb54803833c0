"""Queries of the subpackage against their SQL."""

import duckdb
import pytest

from canopygrid.llm.oracle import ORACLE
from canopygrid.llm.queries import QUERIES

TABLES = "documents embeddings pages benchmark labels conversations"


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(map(repr, df.select(columns).collect()))
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    picks = [names.index(x) for x in columns]
    row = lambda r: "Row(" + ", ".join(f"{x}={r[i]!r}" for x, i in zip(columns, picks, strict=True)) + ")"
    assert got == sorted(row(r) for r in result.fetchall())
