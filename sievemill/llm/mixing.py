"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate that brings its share of the corpus's characters to its target. A document's
count is the inverse of the Poisson distribution with that mean at a uniform number hashed from seed and id;
the document is exploded by its count and the copies are shuffled over the whole output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, set_aside

#: A Poisson number of a larger mean is drawn as a sum of independent ones, so that exp(-mean) stays exact.
MAX_MEAN = 16.0
#: Terms of the distribution that are kept: beyond them the tail of a mean of 16 is below 2**-53.
TERMS = 80
#: Rows of the rate table (640 bytes each) that are broadcast at most.
MAX_SOURCES = 100_000


def source_rates(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """``(mix_source, rate)``: one row for each source; null is a source of its own.

    ``weights`` names targets (sources it lacks get 0); without it a source's target is its share of characters to
    the power ``temperature``, normalised over the sources that have characters. ``epochs`` is the output's size over the input's. A source without
    characters has no share at any rate, so its documents are drawn at the rate ``epochs`` unless ``weights`` gives it 0.
    """
    sizes = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.sum(F.length(F.coalesce(text_col, F.lit("")))).cast("double").alias("size"))
    if weights is None:
        raw = F.when(F.col("size") > 0, F.pow("size", F.lit(float(temperature)))).otherwise(1.0)
    else:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("mix_source") == name, F.lit(float(w))).otherwise(raw)
    sized = sizes.withColumn("raw", raw)
    totals = sized.agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("raw"))).alias("all_raw"))
    share = F.lit(float(epochs)) * F.col("raw") / F.col("all_raw") * F.col("all_size") / F.col("size")
    rate = F.when(F.col("raw") <= 0, 0.0).when(F.col("size") > 0, share).otherwise(float(epochs))
    return sized.join(F.broadcast(totals)).select("mix_source", rate.alias("rate"))


def uniform(*parts: Column) -> Column:
    """52 bits of an MD5 over the parts, in [0, 1)."""
    digest = F.md5(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_steps(mean: Column) -> Column:
    """The distribution function at 0 .. TERMS - 1, by recurrence."""
    first = F.exp(-mean)
    begin = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("out"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        c = a["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(a["out"], F.array(c)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), begin, step, lambda a: a["out"])


def mix_sources(
    docs: DataFrame,
    *,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    epochs: float = 1.0,
    seed: int = 17,
) -> DataFrame:
    """Every column of ``docs`` plus ``copy`` (from 1) and ``mix_key``; rows in random order over all partitions.

    Rows that share an id (or have a null id) get the same count, for the draw depends on seed and id alone.
    Null and empty texts have no size but are drawn at their source's rate (that of a source of only such texts is ``epochs``). An empty table stays empty. Columns of
    ``docs`` named ``copy`` or ``mix_key`` are replaced. The table of rates has a row for each source; it is written first and
    broadcast up to ``MAX_SOURCES`` rows (64 MB), else joined by sort-merge, where Spark splits a hot source.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    docs, restore = set_aside(docs.drop("copy", "mix_key"))
    rates = source_rates(docs, text_col=text_col, source_col=source_col, weights=weights, temperature=temperature, epochs=epochs)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN)).cast("int")
    table = rates.filter("rate > 0").select(F.col("mix_source").alias("_sm_mix"), parts.alias("_sm_parts"), poisson_steps(F.col("rate") / parts).alias("_sm_steps"))
    table = scratch.put(table, "rates")
    table = F.broadcast(table) if table.count() <= MAX_SOURCES else table
    joined = docs.join(table, docs[source_col].eqNullSafe(F.col("_sm_mix")))
    # each number is hashed once for each part: it is the argument of the lambda that goes through the steps, not in its body
    numbers = F.transform(F.sequence(F.lit(1), F.col("_sm_parts")), lambda i: uniform(F.lit(seed), F.col(id_col), i))
    count = F.aggregate(numbers, F.lit(0), lambda a, u: a + F.size(F.filter("_sm_steps", lambda c: c <= u)))
    copies = (
        joined.select(*[F.col(c) for c in docs.columns], F.explode(F.filter(F.sequence(F.lit(0), count), lambda k: k > 0)).alias("copy"))
        .withColumn("mix_key", F.md5(F.concat_ws("/", F.lit("order"), F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("copy").cast("string"))))
    )
    return restore(copies.repartition(F.col("mix_key")).sortWithinPartitions("mix_key"))


def oracle(weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 17) -> str:
    """DuckDB SQL for ``mix_sources(documents)`` without weights: the same draws and the same recurrence."""
    assert weights is None
    return f"""
WITH RECURSIVE sizes AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN size > 0 THEN {epochs!r}::DOUBLE * pow(size, {temperature!r}::DOUBLE) / (SELECT sum(pow(size, {temperature!r}::DOUBLE)) FROM sizes WHERE size > 0)
    * (SELECT sum(size) FROM sizes) / size ELSE {epochs!r}::DOUBLE END AS rate
  FROM sizes),
split AS (SELECT source, greatest(1, ceil(rate / {MAX_MEAN!r}::DOUBLE))::INT AS parts, rate / greatest(1, ceil(rate / {MAX_MEAN!r}::DOUBLE)) AS mean FROM rates),
steps(source, k, p, c) AS (
  SELECT source, 0, exp(-mean), exp(-mean) FROM split
  UNION ALL
  SELECT s.source, s.k + 1, s.p * mean / (s.k + 1), s.c + s.p * mean / (s.k + 1) FROM steps s JOIN split ON s.source IS NOT DISTINCT FROM split.source WHERE s.k < {TERMS - 1}),
draws AS (
  SELECT d.doc_id, d.source, i, CAST(('0x' || substr(md5('{seed}/' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || '/' || CAST(i AS VARCHAR)), 1, 13)) AS BIGINT) / {float(1 << 52)!r}::DOUBLE AS u
  FROM documents d JOIN split s ON d.source IS NOT DISTINCT FROM s.source, unnest(range(1, s.parts + 1)) AS t(i)),
counts AS (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, i, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM w.source AND s.c <= w.u) AS n FROM draws w) GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(copy AS INT) AS copy,
  md5('order/{seed}/' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || '/' || CAST(copy AS VARCHAR)) AS mix_key
FROM documents d JOIN counts c ON d.doc_id = c.doc_id, unnest(range(1, CAST(c.n AS BIGINT) + 1)) AS t(copy)
"""
