"""Registered queries and their oracle SQL (DuckDB), by operator family."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import classify as C
from ..functions import text as T
from ..operators import graph, lexical, logs, metrics, overlap, prep, rank, vectors
from ..sources import sinks
from ..streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of ``Tables``."""

    def put(f):
        register(name, sql)(lambda spark, sf_dir: f(Tables(spark, sf_dir)))
        return f

    return put


# --- retrieval: tokens and BM25 ------------------------------------------------------------------------------------------

#: SQL for the tokenizer on tokens without underscores, slashes and camel humps, which prose has none of but initial capitals.
_SPLIT = "regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+(?:[./][A-Za-z0-9_]+)*')"
TOKENS_SQL = f"""
raw AS (SELECT doc_id, unnest({_SPLIT}) AS w FROM documents),
parts AS (
  SELECT doc_id, w AS p FROM raw WHERE position('.' IN w) > 0 AND position('/' IN w) = 0
  UNION ALL
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(w, '[./]'), lambda x: x <> '')) AS p FROM raw),
named AS (
  SELECT doc_id, p FROM parts
  UNION ALL
  SELECT doc_id, unnest(list_filter(string_split(p, '_'), lambda x: x <> '')) FROM parts WHERE position('_' IN p) > 0 AND position('.' IN p) = 0
  UNION ALL
  SELECT doc_id, unnest(h) FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(p, '([a-z])([A-Z])', '\\1|\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1|\\2', 'g'), '|') AS h FROM parts WHERE position('.' IN p) = 0) WHERE len(h) > 1),
tokens AS (
  SELECT doc_id, p AS term FROM named WHERE strlen(p) <= 64
  UNION ALL SELECT doc_id, lower(p) FROM named WHERE lower(p) <> p AND strlen(p) <= 64),
posts AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY doc_id, term),
docs AS (SELECT doc_id, sum(tf) AS length FROM posts GROUP BY doc_id),
stats AS (SELECT count(*) AS n, greatest(avg(length), 1) AS avgdl FROM docs)
"""
SEARCH = "the clown and token"
SEARCH_TERMS = ["and", "clown", "the", "token"]


def _bm25_sql(terms_cte: str, keys: str) -> str:
    return f"""
WITH {TOKENS_SQL}, q AS ({terms_cte}),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM posts GROUP BY term),
scored AS (
  SELECT {keys} p.doc_id, sum(ln((n - df.df + 0.5) / (df.df + 0.5) + 1) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl))) AS score
  FROM q JOIN posts p ON q.term = p.term JOIN df ON df.term = p.term JOIN docs ON docs.doc_id = p.doc_id, stats GROUP BY ALL)
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["bm25_topk"](spark, sf_dir)


@query("bm25_topk", _bm25_sql(f"SELECT unnest({SEARCH_TERMS!r}) AS term", "") + "SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def _(t):
    return lexical.bm25_search(t.documents, SEARCH, 10).select("doc_id", F.round("score", 6).alias("score"))


_BATCH_TERMS = """SELECT DISTINCT item_id, unnest(list_filter(list_concat(w, list_transform(w, lambda x: lower(x))), lambda x: strlen(x) <= 64)) AS term
  FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9_]+') AS w FROM benchmark)"""


@query("bm25_stored_topk", _bm25_sql(f"SELECT unnest({SEARCH_TERMS!r}) AS term", "") + "SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def _(t):
    """The same question against postings that are stored first, below the shared folder."""
    return lexical.search_bm25(stored_postings(t.spark, t.dir), SEARCH, 10).select("doc_id", F.round("score", 6).alias("score"))


def stored_postings(spark: SparkSession, sf_dir: str) -> lexical.Bm25:
    """Postings of ``documents``, written to a folder of their own for the session."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lexical.store_bm25(lexical.build_bm25(docs), f"{sinks.shared_folder(spark)}/postings-{uuid.uuid4().hex}")


@query("bm25_batch_queries", _bm25_sql(_BATCH_TERMS, "item_id,") + "SELECT * FROM (SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 5")
def _(t):
    q = t.benchmark.select("item_id", F.col("text").alias("query"))
    best = lexical.bm25_batch(lexical.postings(t.documents), q, 5, query_key="item_id")
    return best.select("item_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("tokenize_tf", f"WITH {TOKENS_SQL} SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM posts GROUP BY term")
def _(t):
    return lexical.postings(t.documents).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query("doc_length_stats", f"WITH {TOKENS_SQL} SELECT count(*) AS n, round(avg(length), 6) AS avgdl, CAST(max(length) AS BIGINT) AS longest FROM docs")
def _(t):
    rows = lexical.postings(t.documents).groupBy("doc_id").agg(F.first("length").alias("length"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("length"), 6).alias("avgdl"), F.max("length").alias("longest"))


CODE_CASES = ["getHTTPResponse", "snake_case_name", "src/app/main.py", "module.sub.name", "PDFLoader", "simple", "A_b"]
CODE_TOKENS = [
    ["getHTTPResponse", "gethttpresponse", "get", "HTTP", "http", "Response", "response"],
    ["snake_case_name", "snake", "case", "name"],
    ["src", "app", "main", "py"],
    ["module.sub.name", "module", "sub", "name"],
    ["PDFLoader", "pdfloader", "PDF", "pdf", "Loader", "loader"],
    ["simple"],
    ["A_b", "a_b", "A", "a", "b"],
]


@query("camel_snake_tokens", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{' '.join(sorted(x))}')" for c, x in zip(CODE_CASES, CODE_TOKENS, strict=True)) + ") AS v(input, tokens)")
def _(t):
    rows = t.spark.createDataFrame([(c,) for c in CODE_CASES], "input string")
    return rows.select("input", F.array_join(F.array_sort(T.code_tokens("input")), " ").alias("tokens"))


# --- retrieval: exact search ---------------------------------------------------------------------------------------------

_LINES = "SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"


@query("exact_literal_lines", f"SELECT doc_id, line, substr(text, 1, 400) AS text, 1.0::DOUBLE AS score FROM ({_LINES}) WHERE contains(text, 'token') ORDER BY doc_id, line, text LIMIT 50")
def _(t):
    return lexical.exact_search(t.documents, "token")


@query("exact_regex_lines", f"SELECT doc_id, line, substr(text, 1, 400) AS text, 1.0::DOUBLE AS score FROM ({_LINES}) WHERE regexp_matches(text, '[0-9]{{3}}-[0-9]{{4}}') ORDER BY doc_id, line, text LIMIT 50")
def _(t):
    return lexical.exact_search(t.documents, "[0-9]{3}-[0-9]{4}", mode="regex")


@query("exact_ignore_case", f"SELECT doc_id, line, substr(text, 1, 400) AS text, 1.0::DOUBLE AS score FROM ({_LINES}) WHERE contains(lower(text), 'licensed') ORDER BY doc_id, line, text LIMIT 20")
def _(t):
    return lexical.exact_search(t.documents, "LICENSED", case_sensitive=False, limit=20)


@query("exact_topk_per_doc", f"SELECT doc_id, line, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS r FROM ({_LINES}) WHERE contains(text, 'the')) WHERE r <= 3")
def _(t):
    return lexical.exact_per_document(t.documents, "the", 3)


@query("path_lookup", "SELECT page_id, url FROM pages WHERE lower(regexp_extract(url, '[^/]*$')) = '685' OR lower(url) = '685'")
def _(t):
    return lexical.path_lookup(t.pages, "685", path="url").select("page_id", "url")


@query("exact_dedup_search", f"SELECT DISTINCT substr(text, 1, 100) AS text FROM ({_LINES}) WHERE contains(text, 'Licensed')")
def _(t):
    hits = lexical.lines(t.documents.filter(F.col("text").contains("Licensed"))).filter(F.col("text").contains("Licensed"))
    return hits.select(F.substring("text", 1, 100).alias("text")).dropDuplicates(["text"])


# --- classification ------------------------------------------------------------------------------------------------------

PATH_CASES = [("src/main.py", "source"), ("tests/helpers.py", "source"), ("pkg/tests/helpers.py", "test"), ("test_a.py", "test"), ("a_test.go", "test"), ("x.spec.ts", "test"), ("dist/app.js", "generated"), ("a/node_modules/b.js", "generated"), ("Cargo.toml", "build"), ("Dockerfile.dev", "build"), ("conf/app.yaml", "config"), ("README.md", "doc"), ("bin/tool", "unknown"), ("contest/latest.py", "source")]


def _values(rows: list[tuple], names: str) -> str:
    show = lambda v: "NULL" if v is None else repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") AS v({names})"


@query("classify_paths", _values(PATH_CASES, "path, kind"))
def _(t):
    return t.spark.createDataFrame([(p,) for p, _ in PATH_CASES], "path string").select("path", C.classify_path("path").alias("kind"))


LANGUAGE_CASES = [("a.rs", "rust"), ("a.py", "python"), ("b.go", "go"), ("c.tsx", "typescript"), ("d.mjs", "javascript"), ("e.rb", "unknown"), (".py", "unknown")]


@query("detect_language", _values(LANGUAGE_CASES, "path, language"))
def _(t):
    return t.spark.createDataFrame([(p,) for p, _ in LANGUAGE_CASES], "path string").select("path", C.detect_language("path").alias("language"))


NORMAL_CASES = [("./a/b.py", "a/b.py"), ("a\\b.py", "a/b.py"), ("/etc/passwd", None), ("a/../../b", None), ("", None), ("a/..b/c", "a/..b/c")]


@query("normalise_paths", _values(NORMAL_CASES, "path, normal"))
def _(t):
    return t.spark.createDataFrame([(p,) for p, _ in NORMAL_CASES], "path string").select("path", C.normalise_path("path").alias("normal"))


QUERY_CASES = [("what tests cover UserService?", "TEST"), ("who calls parse_file", "DEPENDENCY"), ('"exact phrase here"', "EXACT"), ("settings.py", "EXACT"), ("find src/config.ts", "EXACT"), ("how does src/config.ts load values", "MIXED"), ("How is validation enforced in NestJS", "CONCEPTUAL"), ("How is Model implemented?", "SYMBOL"), ("where is parse_file defined", "SYMBOL"), ("UserService", "SYMBOL"), ("what is responsible for request logic", "CONCEPTUAL"), ("login form", "MIXED"), ("", "CONCEPTUAL")]


@query("classify_query_types", _values(QUERY_CASES, "query, kind"))
def _(t):
    return t.spark.createDataFrame([(q,) for q, _ in QUERY_CASES], "query string").select("query", C.classify_query("query").alias("kind"))


IDENT_CASES = [("where is parse_file and UserService used", "parse_file UserService used"), ("how does Foo.bar_baz work with foo", "Foo.bar_baz bar_baz does with work"), ("find Q", "Q"), ("is the", "")]


@query("identifiers_top5")
def _(t):
    return t.benchmark.select("item_id", C.extract_identifiers("text").alias("identifiers"))


@query("url_classify", "SELECT page_id, CASE WHEN starts_with(url, 'https') THEN 'https' WHEN starts_with(url, 'http') THEN 'http' ELSE 'other' END AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages")
def _(t):
    u = F.col("url")
    scheme = F.when(u.startswith("https"), "https").when(u.startswith("http"), "http").otherwise("other")
    return t.pages.select("page_id", scheme.alias("scheme"), F.regexp_extract(u, "://([^/?#]+)", 1).alias("host"))


@query("html_title_extract", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def _(t):
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("html_strip_text", "SELECT page_id, CAST(length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\n\\t\\r]+', ' ', 'g'))) AS BIGINT) AS chars FROM pages")
def _(t):
    bare = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \\n\\t\\r]+", " ")
    return t.pages.select("page_id", F.length(F.trim(bare)).cast("long").alias("chars"))


# --- vectors -------------------------------------------------------------------------------------------------------------

_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_DOT = "CAST(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) AS DOUBLE)"


def _vector(t: Tables, i: int) -> list[float]:
    return list(t.embeddings.filter(F.col("vec_id") == i).first().embedding)


@query("knn_brute", f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_DOT.format(a='embedding', b=_Q0)} AS s FROM embeddings) ORDER BY round(s, 9) DESC, vec_id LIMIT 25")
def _(t):
    return vectors.knn(t.embeddings, _vector(t, 0)).select("vec_id", F.round("score", 6).alias("score"))


@query("knn_batch", f"SELECT query_id, vec_id, round(s, 6) AS score, r AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s, 9) DESC, v.vec_id) AS r FROM embeddings q, embeddings v, LATERAL (SELECT {_DOT.format(a='q.embedding', b='v.embedding')} AS s) WHERE q.vec_id % 50 = 0) WHERE r <= 5")
def _(t):
    q = t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.knn_batch(t.embeddings, q, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("knn_two_level", f"""
WITH best AS (SELECT label, vec_id, {_DOT.format(a='embedding', b=_Q0)} AS s FROM embeddings), top AS (SELECT vec_id, s FROM best ORDER BY round(s, 9) DESC, vec_id LIMIT 10)
SELECT chunk_id, round(s, 6) AS score FROM (SELECT d.doc_id AS chunk_id, s, vec_id FROM top JOIN documents d ON d.doc_id % 500 = vec_id ORDER BY round(s, 9) DESC, vec_id, d.source, d.n_chars, d.doc_id LIMIT 5)""")
def _(t):
    v = t.embeddings.select(F.col("vec_id").alias("representation_hash"), "embedding")
    refs = t.documents.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 500).alias("representation_hash"))
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file"), F.col("n_chars").alias("start_line"))
    return vectors.two_level(v, refs, chunks, _vector(t, 0), 5).select("chunk_id", F.round("score", 6).alias("score"))


@query("vector_norms", "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.round(F.sqrt(T.dot("embedding", "embedding")), 6).alias("norm"))


@query("l2_unit", "SELECT vec_id, round(embedding[1] / greatest(n, 1e-6), 6) AS first, round(embedding[len(embedding)] / greatest(n, 1e-6), 6) AS last FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)")
def _(t):
    v = t.embeddings.select("vec_id", T.l2_normalise("embedding").alias("v"))
    return v.select("vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))


@query("vec_label_vote", f"WITH s AS (SELECT label, vec_id, {_DOT.format(a='embedding', b=_Q0)} AS s FROM embeddings WHERE vec_id <> 0), top AS (SELECT * FROM s ORDER BY round(s, 9) DESC, vec_id LIMIT 25) SELECT label, count(*) AS votes FROM top GROUP BY label")
def _(t):
    best = vectors.knn(t.embeddings.filter("vec_id != 0"), _vector(t, 0))
    return t.embeddings.join(F.broadcast(best.select("vec_id")), "vec_id").groupBy("label").agg(F.count("*").alias("votes"))


@query("missing_vectors_anti", "SELECT DISTINCT d.doc_id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL")
def _(t):
    return vectors.missing(t.documents.select("doc_id"), t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("orphan_gc", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def _(t):
    return vectors.without_orphans(t.embeddings.select("vec_id", "label"), t.labels.select(F.col("doc_id").alias("vec_id")), "vec_id")


@query("semantic_ready", "SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM labels) AS refs, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS missing, false AS ready")
def _(t):
    key = lambda df, c: df.select(F.col(c).alias("representation_hash"))
    return vectors.readiness(t.documents, key(t.labels, "doc_id"), key(t.embeddings, "vec_id"))


@query("stale_flag", "SELECT l.doc_id, coalesce(l.quality <> e.label, false) AS stale FROM labels l LEFT JOIN embeddings e ON l.doc_id = e.vec_id")
def _(t):
    stored = t.labels.select(F.col("doc_id").alias("path"), F.col("quality").alias("hash"))
    now = t.embeddings.select(F.col("vec_id").alias("path"), F.col("label").alias("hash"))
    return prep.stale(stored, now).select(F.col("path").alias("doc_id"), "stale")


# --- ranking -------------------------------------------------------------------------------------------------------------

_RRF = """
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
b AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) - length(replace(text, 'e', '')) DESC, doc_id) AS rank FROM documents),
u AS (SELECT doc_id, rank, 1.0::DOUBLE AS w FROM a WHERE rank <= 50 UNION ALL SELECT doc_id, rank, {w}::DOUBLE FROM b WHERE rank <= 50)
SELECT doc_id, round(sum(w / (60 + rank)), 9) AS rrf FROM u GROUP BY doc_id ORDER BY round(sum(w / (60 + rank)), 12) DESC, doc_id LIMIT 20"""


def _two_lists(t: Tables) -> DataFrame:
    d = t.documents
    e = F.length("text") - F.length(F.replace("text", F.lit("e")))
    out = None
    for name, col in (("a", F.col("n_chars")), ("b", e)):
        top = d.select("doc_id", col.alias("v")).orderBy(F.desc("v"), "doc_id").limit(50)
        one = top.select(F.lit(name).alias("retriever"), F.row_number().over(W.orderBy(F.desc("v"), "doc_id")).alias("rank"), F.col("doc_id").alias("file"), F.lit("").alias("symbol"), F.lit(0).alias("start_line"))
        out = one if out is None else out.unionByName(one)
    return out


@query("rrf_hybrid", _RRF.format(w=1.0))
def _(t):
    return rank.rrf(_two_lists(t)).select(F.col("file").alias("doc_id"), F.round("rrf", 9).alias("rrf")).limit(20)


@query("rrf_weighted", _RRF.format(w=2.0))
def _(t):
    return rank.rrf(_two_lists(t), F.when(F.col("retriever") == "b", 2.0).otherwise(1.0)).select(F.col("file").alias("doc_id"), F.round("rrf", 9).alias("rrf")).limit(20)


def _as_evidence(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id")
    kind = F.when(F.col("quality") == 1, "symbol").otherwise("exact")
    return d.select(
        "doc_id", kind.alias("source"), F.concat("source", F.lit("/f.py")).alias("file"), (F.col("doc_id") % 500).cast("int").alias("start_line"), (F.col("doc_id") % 500 + 5).cast("int").alias("end_line"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("symbol_kind"),
        F.lit("").alias("text"), F.lit(1.0).alias("score"), F.when(F.col("quality") == 1, "definition").otherwise("reference").alias("relation"), F.lit(None).cast("string").alias("provenance"),
    )


@query("authority_score", "SELECT d.doc_id, CASE WHEN quality = 1 THEN 35 ELSE 28 END + 10 AS authority_score, 20.0::DOUBLE + CASE WHEN quality = 1 THEN 35 ELSE 28 END + 10 AS final_score FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    return rank.apply_authority(_as_evidence(t), "retry budget", F.lit("MIXED")).select("doc_id", "authority_score", "final_score")


_FUSE = """
WITH e AS (SELECT doc_id, source || '/' || CAST(doc_id // 50 AS VARCHAR) || '.py' AS file, CAST((doc_id % 50) * 10 AS INT) AS s, round(n_chars / 50000.0::DOUBLE, 6) AS score FROM documents),
k AS (SELECT *, 20.0::DOUBLE * score + 10 AS final_score, lower(file) || '::' || CAST(s AS VARCHAR) || ':' || CAST(s + 1 AS VARCHAR) || ':Bm25' AS key FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY final_score DESC, key) AS n FROM k)
SELECT file, s AS start_line, 10 AS authority_score, round(final_score, 6) AS final_score FROM r WHERE n <= 2 ORDER BY r.final_score DESC, file, key LIMIT 40"""


@query("fuse_evidence", _FUSE)
def _(t):
    """All documents as evidence of one conceptual question: two rows of a file stay, forty in all."""
    line = ((F.col("doc_id") % 50) * 10).cast("int")
    no = F.lit(None).cast("string")
    rows = t.documents.select(
        F.lit("bm25").alias("source"), F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 50).cast("string"), F.lit(".py")).alias("file"), line.alias("start_line"), (line + 1).alias("end_line"), no.alias("symbol"), no.alias("symbol_kind"),
        F.lit("").alias("text"), F.round(F.col("n_chars") / F.lit(50000.0), 6).alias("score"), F.lit("reference").alias("relation"), no.alias("provenance"),
    )
    return rank.fuse(rows, "how are sessions stored", "CONCEPTUAL", 40, bounded=False).select("file", "start_line", "authority_score", F.round("final_score", 6).alias("final_score"))


@query("evidence_dedup", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def _(t):
    r = F.row_number().over(W.partitionBy("source", "lang").orderBy(F.desc("n_chars"), "doc_id"))
    return t.documents.select("source", "lang", "n_chars", "doc_id").withColumn("r", r).filter("r = 1").select("source", "doc_id")


@query("per_file_topn", "SELECT source, doc_id, r FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 4")
def _(t):
    r = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).cast("long")
    return t.documents.select("source", "doc_id", "n_chars").withColumn("r", r).filter("r <= 4").select("source", "doc_id", "r")


@query("doc_quota_running", "SELECT doc_id, lang FROM (SELECT doc_id, lang, source, sum(CASE WHEN lang <> 'en' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS q FROM documents) WHERE lang = 'en' OR q <= 2")
def _(t):
    other = (F.col("lang") != "en").cast("int")
    q = F.sum(other).over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id").rowsBetween(W.unboundedPreceding, 0))
    return t.documents.select("doc_id", "lang", "source", "n_chars").withColumn("q", q).filter((other == 0) | (F.col("q") <= 2)).select("doc_id", "lang")


_PACK = "SELECT {k} doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS n, sum(CAST(ceil(strlen(text) / 4.0) AS BIGINT)) OVER ({p} ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM {t}"


@query("budget_pack", "WITH top AS (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40) SELECT doc_id, n, CAST(total AS BIGINT) AS total FROM (" + _PACK.format(k="", p="", t="top") + ") WHERE total <= 100000")
def _(t):
    top = t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(40).withColumn("n", T.token_estimate("text"))
    total = F.sum("n").over(W.orderBy(F.desc("n_chars"), "doc_id").rowsBetween(W.unboundedPreceding, 0))
    return top.withColumn("total", total).filter("total <= 100000").select("doc_id", "n", "total")


@query("budget_pack_by_source", "SELECT source, count(*) AS docs, CAST(max(total) AS BIGINT) AS tokens FROM (" + _PACK.format(k="source,", p="PARTITION BY source", t="documents") + ") WHERE total <= 20000 GROUP BY source")
def _(t):
    total = F.sum("n").over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id").rowsBetween(W.unboundedPreceding, 0))
    rows = t.documents.select("source", "doc_id", "n_chars", T.token_estimate("text").alias("n")).withColumn("total", total).filter("total <= 20000")
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.max("total").alias("tokens"))


@query("token_estimate", "SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", T.token_estimate("text").alias("tokens"))


# --- document preparation ------------------------------------------------------------------------------------------------


@query("dedup_exact_docs", "SELECT sha256(coalesce(text, '')) AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return t.documents.groupBy(T.content_hash(F.coalesce("text", F.lit(""))).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).filter("copies > 1")


_TRIM = r"regexp_replace(text, '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g')"
_DEDUP = f"""
WITH l AS (SELECT doc_id, line, text, {_TRIM} AS bare FROM ({_LINES})),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bare ORDER BY line) AS nth FROM l),
k AS (SELECT *, lag(bare) OVER (PARTITION BY doc_id ORDER BY line) AS prev FROM f WHERE bare = '' OR nth = 1)
SELECT doc_id, string_agg(CASE WHEN bare = '' THEN '' ELSE text END, chr(10) ORDER BY line) AS text FROM k WHERE NOT (bare = '' AND coalesce(prev, 'x') = '') GROUP BY doc_id"""


@query("dedup_lines", _DEDUP)
def _(t):
    return t.documents.select("doc_id", T.deduplicate_lines("text").alias("text"))


@query("collapse_blank_lines", f"""
WITH l AS (SELECT doc_id, line, regexp_replace(text, '[ \\t\\r\\f\\v]+$', '') AS bare FROM ({_LINES})),
k AS (SELECT *, lag(bare) OVER (PARTITION BY doc_id ORDER BY line) AS prev FROM l)
SELECT doc_id, string_agg(bare, chr(10) ORDER BY line) AS text FROM k WHERE NOT (bare = '' AND coalesce(prev, 'x') = '') GROUP BY doc_id""")
def _(t):
    return t.documents.select("doc_id", T.compress_whitespace("text").alias("text"))


@query("redact_tokens", """SELECT doc_id, regexp_replace(text, '(?i)(?:jwt|token)[ ]*[=:][ ]*["'']?[A-Za-z0-9_.-]{20,}["'']?', 'token=[REDACTED]', 'g') AS text FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.regexp_replace("text", "(?i)(?:jwt|token)[ ]*[=:][ ]*[\"']?[A-Za-z0-9_.-]{20,}[\"']?", "token=[REDACTED]").alias("text"))


@query("redact_emails", "SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', '[REDACTED]', 'g') AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", T.redact_patterns("text", ["[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"]).alias("text"))


@query("redact_secrets_chain")
def _(t):
    return t.documents.select("doc_id", T.redact_secrets("text").alias("text"))


@query("secret_counts", "SELECT source, count(*) FILTER (regexp_matches(text, 'token = ')) AS tokens, count(*) FILTER (contains(text, '@')) AS mails FROM documents GROUP BY source")
def _(t):
    return t.documents.groupBy("source").agg(F.count_if(F.col("text").rlike("token = ")).alias("tokens"), F.count_if(F.col("text").contains("@")).alias("mails"))


@query("entropy_docs", """
WITH c AS (SELECT url, unnest(string_split(url, '')) AS ch, length(url) AS n, page_id FROM pages), k AS (SELECT page_id, ch, n, count(*) AS k FROM c WHERE ch <> '' GROUP BY ALL)
SELECT page_id, round(-sum(k / n::DOUBLE * log2(k / n::DOUBLE)), 6) AS entropy FROM k GROUP BY page_id""")
def _(t):
    return t.pages.select("page_id", F.round(T.entropy("url"), 6).alias("entropy"))


@query("chunk_fixed_stride", "SELECT doc_id, CAST((i // 900) AS BIGINT) AS chunk_index, i AS start_char, CAST(least(i + 1000, length(text)) AS BIGINT) AS end_char, substr(text, CAST(i + 1 AS BIGINT), 1000) AS text FROM documents, unnest(range(0, greatest(0, length(text) - 101) + 1, 900)) AS r(i) WHERE text <> ''")
def _(t):
    return prep.chunk_stride(t.documents)


@query("chunk_hash_ids", "SELECT sha256(coalesce(CAST(doc_id AS VARCHAR), '') || chr(0) || CAST(i AS VARCHAR) || chr(0) || CAST(least(i + 1000, length(text)) AS VARCHAR) || chr(0) || sha256(substr(text, CAST(i + 1 AS BIGINT), 1000))) AS chunk_id, doc_id FROM documents, unnest(range(0, greatest(0, length(text) - 101) + 1, 900)) AS r(i) WHERE text <> ''")
def _(t):
    return prep.add_chunk_ids(prep.chunk_stride(t.documents)).select("chunk_id", "doc_id")


@query("chunk_breaks")
def _(t):
    return prep.chunk_breaks(t.documents)


@query("shingle_overlap", """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM w, unnest(range(1, len(w) - 1)) AS r(i))
SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL HAVING count(*) >= 20""")
def _(t):
    return overlap.shingle_overlap(t.documents)


@query("lang_source_profile", "SELECT source, lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 6) AS mean FROM documents GROUP BY source, lang")
def _(t):
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("digest_stats", "SELECT count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, max(n_chars) AS longest FROM documents")
def _(t):
    return t.documents.agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"), F.max("n_chars").alias("longest"))


# --- graph ---------------------------------------------------------------------------------------------------------------

# turns stand in for symbols and calls: a role defines a name in its conversation, each turn calls the next one's role
_SYMS = "SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, role || CAST(conv_id % 7 AS VARCHAR) AS name, CAST(conv_id AS VARCHAR) || '.' || role AS qualified_name, CAST(conv_id AS VARCHAR) AS file, CAST(turn AS INT) AS start_line FROM conversations"
_REFS = "SELECT CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END || CAST(conv_id % 11 AS VARCHAR) AS callee_name, CAST(conv_id AS VARCHAR) AS file, CAST(turn AS INT) AS line, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS caller FROM conversations"


def _symbols(t: Tables) -> DataFrame:
    conv = F.col("conv_id").cast("string")
    return t.conversations.select(F.concat(conv, F.lit(":"), F.col("turn").cast("string")).alias("id"), F.concat("role", (F.col("conv_id") % 7).cast("string")).alias("name"), F.concat(conv, F.lit("."), "role").alias("qualified_name"), conv.alias("file"), F.col("turn").cast("int").alias("start_line"))


def _refs(t: Tables) -> DataFrame:
    conv = F.col("conv_id").cast("string")
    name = F.concat(F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant"), (F.col("conv_id") % 11).cast("string"))
    return t.conversations.select(name.alias("name"), conv.alias("file"), F.col("turn").cast("int").alias("line"), F.concat(conv, F.lit(":"), F.col("turn").cast("string")).alias("parent_symbol"), F.lit("call").alias("kind"))


EDGES_SQL = f"""
s AS ({_SYMS}), r AS ({_REFS}),
bn AS (SELECT name, count(*) AS n, min(id) AS only_id FROM s GROUP BY name), bf AS (SELECT name, file, count(*) AS n, min(id) AS mine FROM s GROUP BY name, file),
e AS (SELECT caller AS caller_symbol_id, callee_name, CASE WHEN bn.n = 1 THEN only_id WHEN bn.n > 1 AND bf.n = 1 THEN mine END AS resolved_symbol_id,
  CASE WHEN bn.n = 1 THEN 'resolved' WHEN bn.n > 1 AND bf.n = 1 THEN 'probable' ELSE 'unresolved' END AS confidence, r.file, r.line
  FROM r LEFT JOIN bn ON bn.name = callee_name LEFT JOIN bf ON bf.name = callee_name AND bf.file = r.file)"""


@query("edge_resolve", f"WITH {EDGES_SQL} SELECT * FROM e")
def _(t):
    return graph.resolve_edges(_refs(t), _symbols(t))


@query("edge_confidence", f"WITH {EDGES_SQL} SELECT confidence, count(*) AS n FROM e GROUP BY confidence")
def _(t):
    return graph.resolve_edges(_refs(t), _symbols(t)).groupBy("confidence").agg(F.count("*").alias("n"))


@query("callers_of", f"WITH {EDGES_SQL}, ids AS (SELECT id FROM s WHERE name = 'user3'), sure AS (SELECT * FROM e WHERE resolved_symbol_id IN (SELECT id FROM ids)) SELECT * FROM sure UNION ALL SELECT * FROM e WHERE callee_name = 'user3' AND NOT EXISTS (SELECT 1 FROM sure)")
def _(t):
    s = _symbols(t)
    return graph.callers(graph.resolve_edges(_refs(t), s), s, "user3").select("caller_symbol_id", "callee_name", "resolved_symbol_id", "confidence", "file", "line")


@query("callees_of", f"WITH {EDGES_SQL} SELECT * FROM e WHERE caller_symbol_id IN (SELECT id FROM s WHERE name = 'user3')")
def _(t):
    s = _symbols(t)
    return graph.callees(graph.resolve_edges(_refs(t), s), s, "user3").select("caller_symbol_id", "callee_name", "resolved_symbol_id", "confidence", "file", "line")


@query("symbol_prefix", f"SELECT id, name FROM ({_SYMS}) WHERE name ILIKE 'U_er1%' OR qualified_name ILIKE 'U_er1%' ORDER BY name, file, start_line LIMIT 100")
def _(t):
    return graph.symbol_prefix(_symbols(t), "U_er1").select("id", "name")


@query("symbol_definitions", f"SELECT id, file, start_line FROM ({_SYMS}) WHERE name = 'system2' OR qualified_name = 'system2'")
def _(t):
    return graph.symbol_definitions(_symbols(t), "system2").select("id", "file", "start_line")


@query("related_tests_like", f"SELECT id FROM (SELECT id, name, qualified_name, 'tests/' || file AS file, start_line FROM ({_SYMS})) WHERE name ILIKE '%ser4%' ORDER BY file, start_line, id LIMIT 20")
def _(t):
    return graph.related_tests(_symbols(t).withColumn("file", F.concat(F.lit("tests/"), "file")), "ser4").select("id")


@query("edge_maintenance", f"WITH {EDGES_SQL} SELECT * FROM e")
def _(t):
    s, r = _symbols(t), _refs(t)
    changed = s.filter("cast(file as int) % 5 = 0").select("file").distinct()
    before = s.join(changed, "file", "left_anti")
    old = graph.resolve_edges(r.join(changed, "file", "left_anti"), before)
    names = graph.affected_names(before.limit(0), s.join(changed, "file", "left_semi"))
    return graph.maintain_edges(old, r, s, changed, names)


@query("interval_overlap_join", """
WITH v AS (SELECT event_id AS id, user_id AS file, CAST(epoch(ts) AS BIGINT) // 60 AS s FROM events)
SELECT a.file, a.id AS id1, b.id AS id2 FROM v a JOIN v b ON a.file = b.file AND a.id < b.id AND greatest(a.s, b.s) <= least(a.s + 30, b.s + 30) + 2""")
def _(t):
    v = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("file"), F.floor(F.unix_timestamp("ts") / 60).alias("start_line")).withColumn("end_line", F.col("start_line") + 30)
    return rank.overlapping(v, v)


# --- logs and events -----------------------------------------------------------------------------------------------------

LOG_CASES = [("Error: disk full", "disk full", None, None), ("WARNING deprecated call", None, "deprecated call", None), ("3 passed, 1 failed now", "now", None, ", 1 failed now"), ("plain line", None, None, None), ("token accepted", None, None, "en accepted")]


@query("log_classify", _values(LOG_CASES, "content, error, warning, success"))
def _(t):
    rows = t.spark.createDataFrame([("x", c[0]) for c in LOG_CASES], "source string, text string")
    return logs.classify_lines(rows).select("content", "error", "warning", "success")


@query("log_summary", "SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS signups, count(*) AS total FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "signup").alias("signups"), F.count("*").alias("total"))


_HIT = lambda kind: "regexp_matches(content, '(?i)" + "|".join(p.replace("'", "''") for p in logs.LINE_CLASSES[kind]) + "')"


@query("log_line_counts", f"""
WITH l AS (SELECT doc_id, line, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS content FROM ({_LINES}))
SELECT doc_id AS source, CAST(max(line) AS BIGINT) AS last_line, {", ".join(f"count(*) FILTER ({_HIT(k)}) AS {k}_count" for k in logs.LINE_CLASSES)} FROM l WHERE content <> '' GROUP BY doc_id""")
def _(t):
    lines = logs.classify_lines(t.documents.select(F.col("doc_id").alias("source"), "text"))
    return logs.summarise_lines(lines).select("source", F.col("last_line").cast("long").alias("last_line"), *[f"{k}_count" for k in logs.LINE_CLASSES])


@query("session_verbs", """
WITH e AS (SELECT user_id, strftime(ts, '%H:%M:%S') AS at, CAST(event_id AS VARCHAR) AS detail, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%H:%M:%S') DESC, CAST(event_id AS VARCHAR) DESC) AS r FROM events)
SELECT user_id AS session, count(*) FILTER (t = 'click') AS edited, count(*) FILTER (t = 'signup') AS created, count(*) FILTER (t = 'error') AS deleted, count(*) FILTER (t = 'view') AS moved, count(*) FILTER (t = 'purchase') AS ran,
  string_agg(detail, ',' ORDER BY r) FILTER (r <= 5) AS last FROM e GROUP BY user_id""")
def _(t):
    verb = F.create_map(*[F.lit(x) for kv in (("click", "Edited"), ("signup", "Created"), ("error", "Deleted"), ("view", "Moved"), ("purchase", "Ran")) for x in kv])
    e = t.events.select(F.col("user_id").alias("session"), F.date_format("ts", "HH:mm:ss").alias("at"), verb[F.col("event_type")].alias("verb"), F.col("event_id").cast("string").alias("detail"))
    return prep.session_summary(e).withColumn("last", F.array_join("last", ","))


@query("project_digest", "SELECT (SELECT count(*) FROM pages) AS files, CAST((SELECT sum(strlen(html)) FROM pages) AS BIGINT) AS bytes, (SELECT string_agg(url, ',' ORDER BY url) FROM (SELECT url FROM pages ORDER BY strlen(html) DESC, url LIMIT 10)) AS largest")
def _(t):
    files = t.pages.select(F.col("url").alias("path"), F.col("html").alias("content"), F.octet_length("html").cast("long").alias("size_bytes"))
    return prep.digest(files).select("files", "bytes", F.array_join("largest", ",").alias("largest"))


@query("event_health_grade", "WITH s AS (SELECT user_id, 40 * max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) + 40 * max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) + 20 * (1 - max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)) AS score FROM events GROUP BY user_id) SELECT user_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s")
def _(t):
    has = lambda k: F.max(F.when(F.col("event_type") == k, 1).otherwise(0))
    s = t.events.groupBy("user_id").agg((has("purchase") * 40 + has("click") * 40 + (F.lit(1) - has("error")) * 20).alias("score"))
    return s.select("user_id", "score", prep.grade(F.col("score")).alias("grade"))


@query("tumbling_counts", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def _(t):
    return watch.windowed_counts(t.events, "1 hour").withColumn("total", F.round("total", 6))


@query("sliding_counts", "SELECT w AS window_start, w + INTERVAL 2 hour AS window_end, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 1 hour, ts), time_bucket(INTERVAL 1 hour, ts) - INTERVAL 1 hour]) AS w FROM events) GROUP BY ALL")
def _(t):
    return watch.windowed_counts(t.events, "2 hours", "1 hour").withColumn("total", F.round("total", 6))


@query("sessionize_events", """
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 minute THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 minute AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def _(t):
    return watch.session_counts(t.events, "30 minutes")


@query("debounce_events", "SELECT user_id, event_type, time_bucket(INTERVAL 1 minute, ts) AS w, max(ts) AS ts, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    e = t.events.select(F.col("user_id").cast("string").alias("root"), F.col("event_type").alias("path"), "ts", F.lit("modify").alias("kind"), F.lit(False).alias("is_dir"))
    c = watch.coalesced(e, "1 minute")
    return c.select(F.col("root").cast("long").alias("user_id"), F.col("path").alias("event_type"), (F.col("due") - F.expr("INTERVAL 1 MINUTE")).alias("w"), "ts", F.col("events").alias("n"))


@query("session_activity", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, max_by(event_type, ts) AS last FROM events GROUP BY user_id")
def _(t):
    k = lambda x: F.count_if(F.col("event_type") == x).alias(x)
    return t.events.groupBy("user_id").agg(k("click"), k("view"), F.max_by("event_type", "ts").alias("last"))


@query("json_props_agg", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


# --- set operations ------------------------------------------------------------------------------------------------------


@query("change_set_union", "SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def _(t):
    return t.documents.select("doc_id").union(t.labels.select("doc_id")).distinct()


@query("symmetric_diff", "(SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def _(t):
    as_name = lambda df: df.select(F.col("doc_id").alias("name"))
    return graph.affected_names(as_name(t.documents), as_name(t.labels)).select(F.col("name").alias("doc_id"))


@query("except_docs", "SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings")
def _(t):
    return t.documents.select("doc_id").subtract(t.embeddings.select("vec_id"))


@query("intersect_sources", "SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'fr'")
def _(t):
    d = t.documents.select("lang", "source")
    return d.filter("lang = 'en'").select("source").intersect(d.filter("lang = 'fr'").select("source"))


@query("digest_merge", "SELECT coalesce(a.doc_id, b.vec_id) AS path, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.vec_id IS NULL THEN 'local' WHEN a.quality = b.label THEN 'same' ELSE 'conflict' END AS status, coalesce(a.quality, b.label) AS hash FROM labels a FULL JOIN embeddings b ON a.doc_id = b.vec_id")
def _(t):
    return prep.merge_digests(t.labels.select(F.col("doc_id").alias("path"), F.col("quality").alias("hash")), t.embeddings.select(F.col("vec_id").alias("path"), F.col("label").alias("hash")))


# --- joins ---------------------------------------------------------------------------------------------------------------


@query("join_inner", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return j.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n", F.round("total", 2).alias("total"))


@query("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("join_right", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("join_full", "SELECT c_nationkey, s_nationkey, c, s FROM (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 5000 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON c_nationkey = s_nationkey")
def _(t):
    a = t.customer.filter("c_acctbal > 5000").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    b = t.supplier.filter("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    return a.join(b, F.col("c_nationkey") == F.col("s_nationkey"), "full")


@query("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def _(t):
    return t.customer.select("c_custkey").join(t.orders.filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    return t.customer.select("c_custkey").join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("join_cross", "SELECT r_name, n_name FROM region, nation")
def _(t):
    return t.nation.select("n_name").crossJoin(F.broadcast(t.region.select("r_name"))).select("r_name", "n_name")


@query("join_asof", "SELECT p.event_id, p.user_id, c.ts AS click_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts")
def _(t):
    e = t.events.filter(F.col("event_type").isin("purchase", "click"))
    click = F.last(F.when(F.col("event_type") == "click", F.col("ts")), ignorenulls=True)
    # of equal times the click comes first, so a purchase sees it
    w = W.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 0).otherwise(1)).rowsBetween(W.unboundedPreceding, 0)
    return e.withColumn("click_ts", click.over(w)).filter("event_type = 'purchase'").select("event_id", "user_id", "click_ts")


@query("join_range", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 10 minute WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def _(t):
    cut = lambda df, n, extra: df.select(F.col("event_id").alias(n), "user_id", F.col("ts").alias(f"{n}_ts"), F.explode(F.array(*[F.floor(F.unix_timestamp("ts") / 600) + i for i in extra])).alias("bin"))
    a = cut(t.events.filter("event_type = 'view'"), "a", (0, 1))
    b = cut(t.events.filter("event_type = 'purchase'"), "b", (0,))
    near = (F.col("b_ts") > F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr("INTERVAL 10 MINUTES"))
    return a.join(b, ["user_id", "bin"]).filter(near).select("a", "b")


@query("join_priority", "SELECT doc_id, coalesce(l.quality, e.label, -1) AS v, CASE WHEN l.doc_id IS NOT NULL THEN 'label' WHEN e.vec_id IS NOT NULL THEN 'vector' ELSE 'none' END AS origin FROM documents LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON doc_id = e.vec_id")
def _(t):
    l = t.labels.select("doc_id", "quality", F.lit(True).alias("in_l"))
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), "label", F.lit(True).alias("in_e"))
    j = t.documents.select("doc_id").join(l, "doc_id", "left").join(e, "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", "label", F.lit(-1)).alias("v"), F.when(F.col("in_l"), "label").when(F.col("in_e"), "vector").otherwise("none").alias("origin"))


# --- aggregates ----------------------------------------------------------------------------------------------------------


@query("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("agg_grouping_sets", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def _(t):
    return t.documents.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"))


@query("agg_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"))


@query("agg_percentile", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY l_returnflag")
def _(t):
    p = lambda q: F.round(F.percentile("l_extendedprice", q), 4)
    return t.lineitem.groupBy("l_returnflag").agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


@query("agg_approx", "SELECT l_suppkey % 20 AS g, count(DISTINCT l_orderkey) AS orders, true AS near FROM lineitem GROUP BY 1")
def _(t):
    """Estimated against exact distinct counts: within four standard errors of the estimate's own setting."""
    near = F.abs(F.approx_count_distinct("l_orderkey", 0.02) / F.count_distinct("l_orderkey") - 1) < 0.08
    return t.lineitem.groupBy((F.col("l_suppkey") % 20).alias("g")).agg(F.count_distinct("l_orderkey").alias("orders"), near.alias("near"))


@query("agg_having_argmax", "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS best, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 10")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_totalprice").alias("best"), F.count("*").alias("n")).filter("n >= 10")


@query("agg_group_list", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"))


@query("agg_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY o_orderpriority")
def _(t):
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).count().na.fill(0, ["F", "O"])


@query("tpch_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def _(t):
    return t.lineitem.filter("l_shipdate <= timestamp'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count("*").alias("n"))


# --- windows and sorts ---------------------------------------------------------------------------------------------------


@query("window_rank", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC)")
def _(t):
    w = W.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"))
    n = W.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.row_number().over(n).cast("long").alias("n"))


@query("window_lag", "SELECT event_id, lag(event_type) OVER w AS prev, lead(value) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.lag("event_type").over(w).alias("prev"), F.lead("value").over(w).alias("next"))


@query("window_frames", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS around, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM events")
def _(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    total = lambda f: F.round(F.sum("value").over(f), 6)
    return t.events.select("event_id", total(w.rowsBetween(-2, 2)).alias("around"), total(w.rowsBetween(W.unboundedPreceding, 0)).alias("running"))


@query("window_ntile", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS q, round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey), 6) AS p FROM customer")
def _(t):
    w = W.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")
    return t.customer.select("c_custkey", F.ntile(4).over(w).cast("long").alias("q"), F.round(F.percent_rank().over(w), 6).alias("p"))


@query("sort_topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)


# --- metrics -------------------------------------------------------------------------------------------------------------

_HITS = "SELECT user_id AS id, event_type AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events"


@query("hit_at_k_mrr", f"""
WITH h AS ({_HITS}), f AS (SELECT id, file, min(rank) AS rank FROM h GROUP BY ALL), p AS (SELECT id, file, row_number() OVER (PARTITION BY id ORDER BY rank, file) AS place FROM f),
b AS (SELECT u.id, min(CASE WHEN file = 'purchase' THEN place END) AS place FROM (SELECT DISTINCT user_id AS id FROM events) u LEFT JOIN p ON u.id = p.id GROUP BY u.id)
SELECT id, CASE WHEN place <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_1, CASE WHEN place <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_3, round(coalesce(1.0::DOUBLE / place, 0), 6) AS rr FROM b""")
def _(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    hits = t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("file"), F.row_number().over(w).alias("rank"))
    asked = t.events.select(F.col("user_id").alias("id")).distinct().withColumn("expected_files", F.array(F.lit("purchase")))
    return metrics.retrieval_metrics(hits, asked).select("id", "hit_1", "hit_3", F.round("rr", 6).alias("rr"))


@query("latency_p50_p95", "SELECT event_type, count(*) AS n, round(median(value), 6) AS p50, round(list_sort(list(value))[CAST(least(floor(count(*) * 0.95), count(*) - 1) AS INT) + 1], 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def _(t):
    return metrics.latency(t.events, ["event_type"], "value").select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("macro_averages", "SELECT source, lang, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY ROLLUP (source, lang)")
def _(t):
    return t.documents.rollup("source", "lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))
