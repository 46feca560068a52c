"""A cleaning pipeline over ``documents``: toxicity, exact and near duplicates, benchmark passages, source mix.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; ``run`` writes each as Parquet to the shared folder and
reads it again as the next one's documents, so a lost executor never costs more than its stage's tasks. All stages but the
last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.decontam import decontaminate
from sievemill.llm.exact_dedup import exact_dedup
from sievemill.llm.mixing import mix_sources
from sievemill.llm.neardup import near_dedup
from sievemill.llm.shared import Scratch
from sievemill.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict to be toxic; it learns from those labelled rows that are not held out.

    Null and empty texts hold no evidence and stay, as do all rows where no label was given. Repeated rows fare alike. An empty table stays
    empty; columns come back as they were, whatever their names.
    """
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clash = ("toxic_score", "toxic_predicted")
    safe = docs.withColumnsRenamed({c: f"_kept_{c}" for c in docs.columns if c in clash})
    kept = score_toxicity(safe, model).filter("toxic_predicted = 0")
    return kept.select(*[F.col(a).alias(b) for a, b in zip(safe.columns, docs.columns, strict=True)])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of equal texts.

    Null and empty texts are one group. A null id comes after all others; of rows that share text and id exactly one stays. An empty table stays empty;
    columns come back as they were, whatever their names.
    """
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near duplicates.

    Texts without a word, null and empty ones among them, are classes of their own. A null id comes after all others; of rows that share text
    and id exactly one stays. Texts are compared whole, however long. An empty table stays empty; columns come back as they were, whatever their names.
    """
    return near_dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark text occurs.

    Null and empty texts hold none and stay; repeated rows fare alike; an empty benchmark drops nothing. An empty table stays empty; columns come
    back as they were, whatever their names.
    """
    safe = docs.withColumnsRenamed({c: f"_kept_{c}" for c in docs.columns if c == "contamination"})
    found = decontaminate(safe, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.col("contamination.n_hit") == 0).select(*[F.col(a).alias(b) for a, b in zip(safe.columns, docs.columns, strict=True)])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in random order, sources at the square root of their shares; columns ``copy`` and ``mix_key`` are added.

    A null source is a source; null and empty texts have no size but are drawn at their source's rate; rows that share an id get the same count.
    An empty table stays empty.
    """
    return mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: The classifier and the similarity estimate are beyond SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; the result is the last stage's frame, read from Parquet."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        mark = len(Scratch.live)
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage-{i}")
        Scratch.drop_since(mark)
        if i > 1:
            scratch.drop(f"stage-{i - 2}")
    return docs
