"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from strandspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def text(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name])
        at = [want.columns.index(c) for c in cols]
        assert sorted(want.columns) == cols
        assert got == sorted(tuple(text(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and out.columns[0] == "contig"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
