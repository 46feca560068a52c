"""Retrieval quality and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _same_file(got: Column, wanted: Column) -> Column:
    a, b = F.lower(got), F.lower(wanted)
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def retrieval_metrics(hits: DataFrame, questions: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """For each question: hit@k, recall@k and reciprocal rank over unique files in order of first rank.

    hits(id, rank, file), questions(id, expected_files). A question without a relevant hit has 0 everywhere.
    """
    first = hits.groupBy("id", "file").agg(F.min("rank").alias("rank"))
    place = first.select("id", "file", F.row_number().over(W.partitionBy("id").orderBy("rank", "file")).alias("place"))
    wanted = questions.select("id", F.size("expected_files").alias("n"), F.explode_outer("expected_files").alias("want"))
    found = wanted.join(place, "id", "left").filter("want is not null and file is not null").filter(_same_file(F.col("file"), F.col("want"))).groupBy("id", "want").agg(F.min("place").alias("place"))
    agg = wanted.select("id", "n").distinct().join(found, "id", "left").groupBy("id").agg(
        *[F.max(F.when(F.col("place") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in ks],
        *[F.coalesce(F.count_if(F.col("place") <= k) / F.greatest(F.first("n"), F.lit(1)), F.lit(0.0)).alias(f"recall_{k}") for k in ks],
        F.coalesce(1.0 / F.min("place"), F.lit(0.0)).alias("rr"),
    )
    return agg


def averages(per_question: DataFrame, by: list[str]) -> DataFrame:
    """Means over everything and over each grouping in one pass."""
    values = [c for c in per_question.columns if c.startswith(("hit_", "recall_")) or c == "rr"]
    return per_question.rollup(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in values])


def latency(samples: DataFrame, by: list[str], value: str = "wall_ms") -> DataFrame:
    """Median, and the discrete 95th percentile sorted[min(int(0.95 n), n - 1)], from ranks: no list is collected."""
    w = W.partitionBy(*by)
    ranked = samples.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"), (F.row_number().over(w.orderBy(value)) - 1).alias("r"), F.count("*").over(w).alias("n"))
    at = F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)
    middle = (F.col("r") == F.floor((F.col("n") - 1) / 2)) | (F.col("r") == F.ceil((F.col("n") - 1) / 2))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when(middle, F.col("v"))).alias("p50"), F.max(F.when(F.col("r") == at, F.col("v"))).alias("p95"))
