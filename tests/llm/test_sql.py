"""Every query of the subpackage with SQL beside it gives the same rows in DuckDB."""

import os

import duckdb
import pytest

from cascadia.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        path = f"{DATA}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    got, want = registry.queries()[name](spark, DATA), con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    clean = lambda names, rows: sorted((tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in sorted(range(len(names)), key=lambda i: names[i])) for r in rows), key=repr)
    assert clean(got.columns, map(tuple, got.collect())) == clean(want.columns, want.fetchall())
