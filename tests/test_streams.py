"""Streams against their batch twins on the event table."""

import os

import pytest
from pyspark.sql import functions as F

from sievemill.streaming import watch

DATA = os.environ.get("SIEVEMILL_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet(f"{DATA}/events.parquet").repartition(2).write.mode("overwrite").parquet(base)
    table = spark.read.parquet(base)
    return table, lambda: spark.readStream.schema(table.schema).parquet(base)


@pytest.mark.parametrize("name,make", [("tumbling", lambda e: watch.windowed_counts(e, "1 day")), ("sliding", lambda e: watch.windowed_counts(e, "2 days", "1 day")), ("session", lambda e: watch.session_counts(e, "1 hour")), ("log", lambda e: watch.session_log(e.select("ts", F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("src"), F.lit(None).cast("string").alias("dest")), "1 hour"))])
def test_windows(spark, events, tmp_path, name, make):
    table, stream = events
    watch.run_once(make(stream()), None, f"{tmp_path}/cp", f"w_{name}", "complete")
    plain = lambda df: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert plain(spark.table(f"w_{name}")) == plain(make(table))


def test_stream_join(spark, events, tmp_path):
    table, stream = events
    pick = lambda e, k: e.filter(F.col("event_type") == k)
    make = lambda e: watch.stream_join(pick(e(), "view"), pick(e(), "click"), "user_id", "6 hours", "40 days")
    watch.run_once(make(stream), None, f"{tmp_path}/cp", "joined", "append")
    assert sorted(map(str, spark.table("joined").collect())) == sorted(map(str, make(lambda: table).collect()))


def test_tail_and_access(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("one\ntwo\n")
    watch.run_once(watch.tail_lines(spark, f"{tmp_path}/logs"), None, f"{tmp_path}/cp", "tail", "append")
    assert sorted(r.line for r in spark.table("tail").collect()) == ["one", "two"]
    dirty = spark.createDataFrame([("a", "clean"), ("b", "paths"), ("c", "unknown")], "root string, mode string")
    at = lambda s: F.lit(s).cast("timestamp")
    assert [r.access for r in watch.access_mode(dirty, at("2024-01-01 00:00:00"), at("2024-01-01 00:01:00")).collect()] == ["skip", "local", "full"]
    assert {r.access for r in watch.access_mode(dirty, at("2024-01-01 00:00:00"), at("2024-01-01 01:00:00")).collect()} == {"full"}
