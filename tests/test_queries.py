"""Every query with SQL beside it gives the rows that DuckDB gives; every other query gives rows."""

import os

import duckdb
import pytest

from tintflow.plans import queries as Q


def same(a, b):
    def norm(x, cols):
        return sorted(str(tuple(None if v is None or v != v else round(float(v), 7) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)) for r in x[cols].astype(object).where(x[cols].notna(), None).values.tolist())

    cols = sorted(a.columns)
    return sorted(b.columns) == cols and norm(a, cols) == norm(b, cols)


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{data}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(Q.Q))
def test_query(spark, data, db, name):
    f, sql = Q.Q[name]
    got = f(spark, data).toPandas()
    if sql:
        assert same(got, db.execute(sql).fetchdf())
    else:
        assert len(got)
