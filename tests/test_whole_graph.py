"""Graph queries over all turns: their SQL without its own turn filter."""

import duckdb
import pytest
from test_catalogue import DATA, rows_of

from sievemill.plans.catalogue import ORACLES, QUERIES

NAMES = ["edge_resolve", "edge_confidence", "callers_of", "callees_of", "symbol_prefix", "symbol_definitions", "related_tests_like", "edge_maintenance"]


@pytest.mark.parametrize("name", NAMES)
def test_all_turns_count(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    cur = con.execute(ORACLES[name].replace(" WHERE turn < 3", ""))
    names = [c[0] for c in cur.description]
    df = QUERIES[name](spark, DATA)
    assert rows_of(df.collect(), [df.columns.index(c) for c in names]) == rows_of(cur.fetchall(), range(len(names)))


def test_union_takes_every_document(spark, tmp_path):
    spark.range(10).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(9, 12).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r.doc_id for r in QUERIES["change_set_union"](spark, str(tmp_path)).collect()) == list(range(12))
