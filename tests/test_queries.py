"""Every registered query against its SQL counterpart in another engine, at the smallest scale."""

import os

import duckdb
import pytest

from sessionloom import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, oracle, name):
    df = core.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in core.ORACLE_SQL:
        assert rows
        return
    found = oracle.execute(core.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(found.fetchall(), columns)


def test_entry_points():
    import __spark_entry__

    assert set(core.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
