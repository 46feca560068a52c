"""Registered queries of the corpus operators and their SQL, where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact_dedup, langid, mixing, neardup, quality, secrets, toxicity, warc
from .shared import ROW, SRC, Scratch, identified


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return decontam.digest_columns(found)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), scratch.path("archives"), scratch)
    return warc.read_warc(spark, scratch.path("archives"), scratch)


#: A conversation whose texts consist of the template's control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.digest_columns(chat.format_chat(rows.unionByName(planted)))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "exact")
    rows = identified(_table(spark, sf_dir, "documents"), scratch)
    return exact_dedup.exact_groups(rows, scratch).drop(SRC, ROW)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("selected"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "near")
    rows = identified(_table(spark, sf_dir, "documents"), scratch)
    return neardup.near_groups(rows, scratch).drop(SRC, ROW)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = langid.learn_profiles(docs.filter(~held_out))
    found = langid.predict_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_benchmark_decontamination": op1,
    "op2_warc_round_trip": op2,
    "op3_chat_formatting": op3,
    "op4_exact_dedup": op4,
    "op5_secret_scan": op5,
    "op6_source_mixing": op6,
    "op7_quality_classifier": op7,
    "op8_minhash_near_dedup": op8,
    "op9_language_id": op9,
    "op10_toxicity": op10,
    "pipeline": pipeline,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT item, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
  FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT m FROM windows),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
spans AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM docs, lengths, unnest(range(1, len(w) - m + 2)) AS r(i)),
hits AS (SELECT DISTINCT s.doc_id, s.i, s.m, x.item FROM spans s JOIN windows x ON s.m = x.m AND s.t = x.t),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM hits, unnest(range(i, i + m)) AS r(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""

OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
best AS (SELECT html, max(page_id) AS page_id FROM p GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, 1 + 10 * CAST(i // 8 AS INT), 10) AS BIGINT) >> CAST(5 * (7 - i % 8) AS INT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN p.page_id = b.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = b.page_id THEN NULL ELSE b.page_id END AS refers_to
FROM p JOIN best b ON p.html = b.html
"""

OP3_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, row_number() OVER w - 1 AS nth, lag(role) OVER w AS before,
    length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/ROLE\]|/INST\]|/SYS\]|ROLE\]|INST\]|SYS\]|/s>|s>)', '\1\\\2', 'g'))
    + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 END AS n
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)),
sized AS (
  SELECT *, CASE WHEN nth = 0 THEN role IN ('system', 'user') WHEN role = 'user' THEN before IN ('system', 'assistant') ELSE role = 'assistant' AND before = 'user' END AS ok FROM placed),
grouped AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(3 + sum(n) AS BIGINT) AS formatted_chars,
    coalesce(min(nth) FILTER (NOT coalesce(ok, false)), CASE WHEN arg_max(role, nth) <> 'assistant' THEN count(*) END) AS error_turn,
    sha256('0' || string_agg(CASE WHEN role = 'assistant' THEN '010' ELSE '000' END, '' ORDER BY nth)) AS flags_sha256
  FROM sized GROUP BY conv_id)
SELECT *, error_turn IS NULL AS valid FROM grouped
"""

OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""

ORACLES = {
    "op1_benchmark_decontamination": OP1_SQL,
    "op2_warc_round_trip": OP2_SQL,
    "op3_chat_formatting": OP3_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op6_source_mixing": mixing.oracle(),
}
