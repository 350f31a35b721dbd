"""Each query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os

import pytest

from colloq import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    show = lambda v: "null" if v is None or v != v else str(int(v)) if isinstance(v, float) and math.isfinite(v) and v == int(v) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    other = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in other.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain([tuple(r[i] for i in order) for r in other.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0
