"""Set-valued and rule cases that the catalogue's tables don't reach."""

import pytest
from pyspark.sql import functions as F

from sievemill.functions import classify as C
from sievemill.functions import registry
from sievemill.functions import text as T
from sievemill.operators import lexical, logs, prep, vectors


def test_exact_search_modes(spark):
    d = spark.createDataFrame([(1, "Foo\nfoo_bar\nfoo"), (2, None), (3, "x" * 500 + "foo")], "doc_id long, text string")
    got = lambda q, **k: [(r.doc_id, r.line) for r in lexical.exact_search(d, q, **k).collect()]
    assert got("foo") == [(1, 2), (1, 3), (3, 1)]
    assert got("foo", mode="identifier") == [(1, 3)]
    assert got("FOO", case_sensitive=False, limit=2) == [(1, 1), (1, 2)]
    assert got("^fo{2}$", mode="regex") == [(1, 3)]
    assert lexical.exact_search(d, "xfoo").count() == 1 and len(lexical.exact_search(d, "xfoo").first().text) == 400
    assert got("a.b") == []


def test_bm25_cases(spark):
    d = spark.createDataFrame([(1, "Alpha beta"), (2, "alpha"), (3, "gamma"), (4, ""), (5, None), (6, "alpha")], "doc_id long, text string")
    top = lambda q, k=10: [r.doc_id for r in lexical.bm25_search(d, q, k).collect()]
    assert top("alpha") == [2, 6, 1] and top("absent") == [] and top("alpha", 1) == [2]
    assert top("alpha alpha") == top("alpha")  # repeated terms count once
    assert top("Alpha")[0] == 1  # case counts as a term of its own
    batch = lexical.bm25_batch(lexical.postings(d), spark.createDataFrame([(0, "alpha")], "query_id int, query string"), 10)
    assert [r.doc_id for r in batch.orderBy("rank").collect()] == top("alpha")
    assert lexical.bm25_delete(lexical.postings(d), d.filter("doc_id = 2")).filter("doc_id = 2").count() == 0


def test_baseline(spark):
    files = spark.createDataFrame([("src/user_store.py", "x"), ("a.py", "uses user_store.py here"), ("b.py", "")], "path string, text string")
    assert [r.path for r in lexical.baseline_search(files, "find user_store.py").collect()] == ["src/user_store.py", "a.py"]


def test_registries(spark):
    registry.register_embedder("two", lambda texts: [[3.0, 4.0] for _ in texts], 2)
    df = spark.createDataFrame([("a",)], "t string")
    assert df.select(registry.EMBEDDERS["two"](F.col("t"))).first()[0] == pytest.approx([0.6, 0.8])
    registry.register_embedder("bad", lambda texts: [[1.0] for _ in texts], 2)
    with pytest.raises(Exception, match="dimension"):
        df.select(registry.EMBEDDERS["bad"](F.col("t"))).collect()
    logs.register_parser("generic", logs.PARSERS["generic"])


def test_vector_upkeep(spark):
    refs = spark.createDataFrame([(1, "h1", "c"), (2, "h1", "c"), (3, "h2", "c")], "chunk_id int, representation_hash string, content_hash string")
    v = spark.createDataFrame([("h1", "m", 1, [1.0]), ("old", "m", 1, [1.0]), ("h1", "m", 2, [1.0])], "representation_hash string, model_id string, version int, embedding array<double>").withColumn("dimension", F.size("embedding"))
    assert [r[0] for r in vectors.missing(refs, v).collect()] == ["h2"]
    assert vectors.without_orphans(v, refs).count() == 2
    assert vectors.without_stale(v, "m", 2, 1).count() == 1
    assert vectors.upsert(v.drop("dimension"), v.drop("dimension").filter("version = 2"), ["representation_hash", "model_id", "version"], 1).count() == 3
    assert vectors.readiness(refs, refs, v).first().missing == 1


def test_change_sets(spark):
    known = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, hash string")
    now = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "1")], "path string, hash string")
    assert {r.path for r in prep.change_set(spark.createDataFrame([("d",), ("a",)], "path string"), known, now).collect()} == {"a", "c", "d"}
    assert {r.path: r.stale for r in prep.stale(known.union(spark.createDataFrame([("z", "1")], known.schema)), now).collect()} == {"a": True, "b": False, "z": False}


def test_payload_and_selection(spark):
    chunks = spark.createDataFrame([("src/a.py", 0, "x"), ("doc/b.md", 0, "needle")], "path string, start_char int, text string")
    injected = spark.createDataFrame([("p", 1, "old"), ("p", 2, "new")], "path string, seq int, text string")
    got = {(r.path, r.text) for r in prep.session_payload(chunks, injected, ["src/"], "NEEDLE").collect()}
    assert got == {("src/a.py", "x"), ("doc/b.md", "needle"), ("p", "new")}
    files = spark.createDataFrame([("auth.py", "login", 1), ("x.md", "auth", 2), ("z.md", "", 3)], "path string, content string, mtime int")
    assert [r.path for r in prep.select_files(files, ["auth"]).collect()] == ["auth.py", "x.md"]
    assert prep.add_baselines(files.union(spark.createDataFrame([("../e.py", "", 1)], files.schema))).count() == 3


def test_visibility_and_buckets(spark):
    rows = spark.createDataFrame([("rust", "f", "pub fn f"), ("python", "_f", "def _f"), ("go", "Run", "func Run"), ("typescript", "g", "export const g"), ("cobol", "x", "")], "l string, n string, d string")
    assert [r[0] for r in rows.select(C.visibility(F.col("l"), F.col("n"), F.col("d"))).collect()] == ["public", "private", "public", "public", "unknown"]
    paths = spark.createDataFrame([("tests/a.py",), ("README.md",), ("x.toml",), ("run.sh",), ("api/x.py",), ("zzz",)], "p string")
    assert [r[0] for r in paths.select(C.summary_bucket("p")).collect()] == ["tests", "docs", "config", "scripts", "backend", "other"]
    assert [r[0] for r in paths.select(C.is_skipped("p")).collect()] == [False] * 6
    assert [r[0] for r in spark.createDataFrame([("a/node_modules/b.js",), (".git",), ("target/x",), ("src/targets.py",)], "p string").select(C.is_excluded("p")).collect()] == [True, True, True, False]


def test_preview(spark):
    text = "alpha " * 45 + "\n" + "rest " * 40
    out = spark.createDataFrame([(text,)], "t string").select(T.preview("t", "alpha to")).first()[0]
    assert out.startswith("**ALPHA** ") and "rest" not in out


def test_external_answers(spark):
    from sievemill.sources import external

    text = '[1] function "go" at src/a.ts:3-9 (score: 0.82)\n```ts\nfunction go() {}\n```\n[2] class "Big" at b.py:1\nnoise'
    rows = external.parse_hits(spark.createDataFrame([("q", text)], "id string, text string")).orderBy("rank").collect()
    assert [tuple(r)[1:] for r in rows] == [(1, "function", "go", "src/a.ts", 3, 9, 0.82, "function go() {}"), (2, "class", "Big", "b.py", 1, 1, None, None)]
    calls = external.parse_calls(spark.createDataFrame([("q", "Callers:\n-> run (src/a.py:4)\n-> load (b.py:9) [unresolved]")], "id string, text string")).collect()
    assert [(r.symbol, r.line, r.score) for r in calls] == [("run", 4, 0.9), ("load", 9, 0.5)]
