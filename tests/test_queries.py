"""Every query against its SQL in the other engine, on the smallest test tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=str), sorted(columns)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(cursor.fetchall(), [d[0] for d in cursor.description])


def test_entry(spark):
    assert entry.entry(spark).count() == 20
