"""Every query against its SQL in DuckDB."""

import math
import os
import sys

import pytest

from quarry.plans import catalogue, lattice_queries  # noqa: F401  the second registers its own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    sys.path.append("/opt/oracle")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, sf_dir, duck, name):
    made = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in made.description]
    cols = sorted(names)
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in made.fetchall()), key=repr)
    got = catalogue.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == cols
    assert rows_of(got) == want


def test_every_query_without_sql_runs(spark, sf_dir):
    for name in set(catalogue.QUERIES) - set(catalogue.SQL):
        assert catalogue.QUERIES[name](spark, sf_dir).count() >= 0
