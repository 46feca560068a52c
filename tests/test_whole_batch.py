"""Every benchmark row is a query: the SQL without its own filter of items."""

import duckdb
from test_catalogue import DATA, rows_of

from sievemill.plans.catalogue import ORACLES, QUERIES


def test_every_item_is_a_query(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(ORACLES["bm25_batch_queries"].replace(" WHERE item_id < 10", ""))
    names = [c[0] for c in cur.description]
    df = QUERIES["bm25_batch_queries"](spark, DATA)
    got = df.collect()
    assert any(r.item_id >= 10 for r in got)
    assert rows_of(got, [df.columns.index(c) for c in names]) == rows_of(cur.fetchall(), range(len(names)))
