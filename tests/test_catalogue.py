"""Every registered query with SQL against DuckDB on the smallest tables; every other one runs."""

import math
import os

import duckdb
import pytest

from sievemill.plans.catalogue import ORACLES, QUERIES, flagship

DATA = os.environ.get("SIEVEMILL_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if hasattr(v, "isoformat") else v


def rows_of(rows, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = df.collect()
    if name not in ORACLES:
        assert len(columns) == len(set(columns))
        return
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    assert rows_of(got, [df.columns.index(c) for c in columns]) == rows_of(cur.fetchall(), [names.index(c) for c in columns])


def test_flagship(spark):
    assert flagship(spark, DATA).count() > 0


@pytest.mark.parametrize("partitions", ["1", "3", "7"])
def test_same_result_whatever_the_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = [tuple(r) for r in QUERIES["bm25_batch_queries"](spark, DATA).orderBy("item_id", "rank").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == [tuple(r) for r in QUERIES["bm25_batch_queries"](spark, DATA).orderBy("item_id", "rank").collect()]
