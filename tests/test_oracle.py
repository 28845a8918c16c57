"""Every query that SQL can express gives the same rows in DuckDB."""

import math

import pytest

from tessera.plans import reference

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def tidy(v):
    return None if v is None else ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(reference.SQL))
def test_same_rows(spark, con, name):
    df = reference.QUERIES[name](spark, DIR)
    rows = con.execute(reference.SQL[name])
    names = [d[0] for d in rows.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    want = sorted((tuple(tidy(r[names.index(c)]) for c in order) for r in rows.fetchall()), key=repr)
    assert sorted((tuple(tidy(r[c]) for c in order) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(reference.QUERIES) - set(reference.SQL)))
def test_other_queries_return_rows(spark, name):
    assert reference.QUERIES[name](spark, DIR).count() > 0
