import datetime as dt

import pytest
from pyspark.sql import functions as F

from sievemill.operators import graph, logs, metrics, prep, rank, vectors


def evidence(spark, rows):
    base = dict(source="exact", file="a.py", start_line=1, end_line=5, symbol=None, symbol_kind=None, text=None, score=1.0, relation="reference", provenance=None)
    names = list(base)
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], rank.SCHEMA)


def test_definition_beats_document(spark):
    rows = evidence(spark, [dict(file="docs/a.md", text="uses parse_file"), dict(source="symbol", file="src/p.py", symbol="parse_file", symbol_kind="function_definition", text="def parse_file(x):", score=0.7, relation="definition")])
    top = rank.fuse(rows, "where is parse_file defined", "SYMBOL").first()
    assert top.file == "src/p.py" and top.authority_score == 35 + 18 + 10 + 5


def test_test_intent(spark):
    rows = evidence(spark, [dict(file="src/user.py"), dict(source="test", file="pkg/tests/test_user.py", score=0.9, relation="test")])
    assert rank.fuse(rows, "what tests cover User?", "TEST").first().file == "pkg/tests/test_user.py"
    assert rank.fuse(rows, "where is User", "SYMBOL").first().file == "src/user.py"


def test_stale_path_sinks(spark):
    rows = evidence(spark, [dict(file="archive/a.py"), dict(file="src/b.py")])
    assert [r.file for r in rank.fuse(rows, "login form", "MIXED").collect()] == ["src/b.py", "archive/a.py"]


def test_collapse_is_greedy_per_file(spark):
    rows = evidence(spark, [dict(start_line=i * 10, end_line=i * 10 + 1, score=s, source="bm25") for i, s in enumerate([0.9, 0.8, 0.7, 0.6, 0.5])])
    assert rank.fuse(rows, "how is caching handled here", "CONCEPTUAL").count() == 2
    near = evidence(spark, [dict(start_line=i, end_line=i + 3, source="bm25", score=0.1 * i) for i in range(1, 6)])
    assert rank.fuse(near, "x y", "MIXED").count() == 2  # the first, and one that overlaps


def test_documents_are_limited_where_code_is_asked(spark):
    rows = evidence(spark, [dict(file=f"docs/{i}.md") for i in range(5)] + [dict(file="src/x.py")])
    kinds = [r.file.endswith(".md") for r in rank.fuse(rows, "login form", "MIXED").collect()]
    assert sum(kinds) == 2


def test_definition_survives_the_cut(spark):
    rows = evidence(spark, [dict(file=f"src/{i}.py") for i in range(3)] + [dict(source="symbol", relation="definition", file="legacy/d.py", score=0.0)])
    assert rank.fuse(rows, "login form", "MIXED", top_n=2).filter("relation = 'definition'").count() == 1


def test_pack_stops_at_the_first_overflow(spark):
    rows = rank.apply_authority(evidence(spark, [dict(file="src/a.py", text="x" * 100), dict(file="src/b.py", text="y" * 100, score=0.5)]), "login form", F.lit("MIXED"))
    whole = rank.pack(rows, "q", "MIXED").first()
    assert whole.files == ["src/a.py", "src/b.py"] and "# Evidence Pack — MIXED" in whole.markdown
    assert rank.pack(rows, "q", "MIXED", budget=90).first().files == ["src/a.py"]
    assert rank.pack(rows, "q", "MIXED", budget=1).first().files == []


def test_sufficiency(spark):
    rows = evidence(spark, [dict(source="symbol", relation="definition", file="src/a.py")])
    assert rank.sufficiency(rows, "SYMBOL").first()[0] == "STRONG"
    assert rank.sufficiency(rows.limit(0), "SYMBOL").first()[0] == "INSUFFICIENT"


SYMBOLS = "id string, name string, qualified_name string, file string, start_line int"


def test_edges_and_maintenance(spark):
    syms = spark.createDataFrame([("1", "f", "m.f", "a", 1), ("2", "g", "m.g", "a", 5), ("3", "g", "n.g", "b", 1)], SYMBOLS)
    refs = spark.createDataFrame([("f", "b", 3, "3", "call"), ("g", "a", 2, "1", "call"), ("g", "c", 1, None, "call"), ("n.g", "c", 2, None, "call"), ("zz", "c", 3, None, "call")], "name string, file string, line int, parent_symbol string, kind string")
    edges = graph.resolve_edges(refs, syms)
    got = {(r.callee_name, r.file): (r.resolved_symbol_id, r.confidence) for r in edges.collect()}
    assert got == {("f", "b"): ("1", "resolved"), ("g", "a"): ("2", "probable"), ("g", "c"): (None, "unresolved"), ("n.g", "c"): ("3", "resolved"), ("zz", "c"): (None, "unresolved")}
    assert {r.confidence for r in graph.callers(edges, syms, "g").collect()} == {"probable", "resolved"}
    assert [r.callee_name for r in graph.callers(edges, syms, "zz").collect()] == ["zz"]
    later = syms.filter("id != '3'")
    kept = graph.maintain_edges(edges, refs, later, spark.createDataFrame([("b",)], "file string"), graph.affected_names(syms.filter("file = 'b'"), later.filter("file = 'b'")))
    assert sorted(map(str, kept.collect())) == sorted(map(str, graph.resolve_edges(refs, later).select(*kept.columns).collect()))


def test_tests_need_a_test_like_name(spark):
    syms = spark.createDataFrame([("1", "Query", "Query", "tests/q.py", 1), ("2", "Q", "Q", "tests/q.py", 9)], SYMBOLS)
    assert [r.id for r in graph.related_tests(syms, "Q").collect()] == ["2"]
    files = spark.createDataFrame([("t/test_foo_bar.py",), ("contest.py",), ("foobar_test.go",)], "path string")
    assert [r.path for r in graph.test_files(files, "FooBar").collect()] == ["foobar_test.go", "t/test_foo_bar.py"]


def test_call_path(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "a")], "caller_symbol_id string, resolved_symbol_id string")

    def checkpoint(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    assert graph.call_path(edges, "a", "c", checkpoint).first().path == ["a", "b", "c"]
    assert graph.call_path(edges, "c", "zz", checkpoint).count() == 0


LOGS = {
    "app.log": 'start\nTraceback (most recent call last):\n  File "a.py", line 1, in <module>\n    f()\n  File "b.py", line 9, in f\n    x()\nValueError: bad value\nend',
    "svc.log": "Exception in thread \"main\" java.lang.IllegalStateException: boom\n\tat java.util.List.get(List.java:1)\n\tat com.acme.Main.run(Main.java:42)\nCaused by: java.io.IOException: disk\n\tat com.acme.Disk.read(Disk.java:7)",
    "web.log": "TypeError: x is undefined\n    at load (node_modules/lib/index.js:1:2)\n    at main (src/app.js:10:5)\nok",
    "misc.txt": "all fine\nERROR: something failed in core.c:12",
}


def test_parsers_report_each_error_once(spark):
    rows = logs.parse_errors(spark.createDataFrame(list(LOGS.items()) + [("null", None)], "source string, text string")).collect()
    got = sorted((r.source, r.error_type, r.file_hint, r.line_hint, r.parser_type) for r in rows)
    assert got == [
        ("app.log", "ValueError", "b.py", 9, "python"),
        ("misc.txt", "ERROR", "core.c", 12, "generic"),
        ("svc.log", "IOException", "Disk.java", 7, "java"),
        ("svc.log", "IllegalStateException", "Main.java", 42, "java"),
        ("web.log", "TypeError", "src/app.js", 10, "javascript"),
    ]


def test_line_classes_overlap(spark):
    one = logs.classify_lines(spark.createDataFrame([("s", "error: token not ok\n\n  warning: late")], "source string, text string")).collect()
    assert one[0].error == "token not ok" and one[0].success is not None and one[1].line_number == 3
    assert logs.summarise_lines(logs.classify_lines(spark.createDataFrame([("s", "error: x")], "source string, text string"))).first().error_count == 1
    assert logs.generic_errors(spark.createDataFrame([("s", "a\nfatal: b at x.py:3\nc")], "source string, text string")).first().severity == "critical"


def test_chunks_cover_the_text(spark):
    text = "para one. " * 30 + "\n\n" + "word " * 100
    rows = prep.chunk_breaks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), 120, 20).orderBy("chunk_index").collect()
    assert rows[0].start_char == 0 and rows[-1].end_char == len(text)
    assert all(b.start_char <= a.end_char and b.start_char > a.start_char for a, b in zip(rows, rows[1:], strict=False))


def test_notes_round_trip(spark):
    note = [("handoff_2024-01-02_03-04-05.md", dt.datetime(2024, 1, 2, 3, 4, 5), "s1", "Did things", ["one", "two"], [], ["a.py"])]
    df = spark.createDataFrame(note, "filename string, created timestamp, session_id string, summary string, next_steps array<string>, blockers array<string>, files_modified array<string>")
    back = prep.parse_note(prep.render_note(df)).first()
    assert tuple(back[c] for c in df.columns) == tuple(df.first())
    assert prep.search_notes(df, "TWO").count() == 1
    assert prep.recent_notes(df, 7, F.lit("2024-01-05").cast("timestamp")).count() == 1
    assert prep.expired_notes(df, 1, F.lit("2024-01-05").cast("timestamp")).count() == 1
    assert prep.notes_summary(df).first().files == 1


def test_bundle_digest_checklist_health(spark):
    s = spark.createDataFrame([(2, "B", ""), (1, "A", "x\nx\npassword = hunter22")], "ord int, title string, body string")
    text = prep.bundle(s).first().markdown
    assert text.index("## A") < text.index("## B") and "None" in text and "hunter22" not in text and text.count("\nx\n") == 1
    files = spark.createDataFrame([("README.md", 10), ("src/main.py", 50), ("tests/test_a.py", 5), ("docs/api.md", 7)], "path string, size_bytes long").withColumn("content", F.lit(""))
    assert prep.digest(files).first().files == 4
    assert prep.checklist(files).filter("group = 'README'").first().n == 1
    assert prep.project_health(files).first().grade == "D"
    assert prep.architecture(files, spark.createDataFrame([("django",)], "name string")).first().frameworks == ["Django"]
    assert prep.conflict_markers(spark.createDataFrame([("a", "<<<<<<< x"), ("b", "ok")], "path string, content string")).count() == 1
    assert prep.process_match(spark.createDataFrame([(1, ["npm", "run", "dev"]), (2, ["run"])], "pid int, tokens array<string>"), [["run", "dev"]]).first().pid == 1


def test_summaries(spark):
    files = spark.createDataFrame([("a.py", '"""Purpose."""\nimport os\nclass A:\n    "doc"\n    def f(self): pass\n'), ("b.ts", "import x from 'y'\nexport function go() {}"), ("bad.py", "def (")], "path string, content string")
    got = {r.path: r for r in prep.summarise_files(files).collect()}
    assert got["a.py"].purpose == "Purpose." and got["a.py"].surface == ["A"] and got["b.ts"].dependencies == ["y"] and got["bad.py"].structure == {"lines": 1, "unparsed": 1}
    short = {r.path: r.compressed for r in prep.compress_code(files).collect()}
    assert "class A:" in short["a.py"] and "import os" not in short["a.py"]
    assert prep.todo_profile(spark.createDataFrame([("x", "TODO TODO FIXME")], "path string, content string")).first().todo == 2


def test_sessions(spark):
    log = spark.createDataFrame([("s", "[10:00:00] Edited a.py"), ("s", "[10:00:01] Ran tests"), ("s", "noise")], "session string, line string")
    r = prep.session_summary(prep.session_events(log)).first()
    assert (r.edited, r.ran, r.last) == (1, 1, ["tests", "a.py"])


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert vectors.knn(v, [1.0, 0.0], 1).first().vec_id == 1
    assert vectors.knn(v, [1.0, 0.0, 0.0]).first().score == 0.0  # other dimension
    with pytest.raises(Exception, match="dimension"):
        vectors.upsert(v, spark.createDataFrame([(3, [1.0])], v.schema), ["vec_id"], 2).collect()


def test_metrics(spark):
    hits = spark.createDataFrame([("q", 1, "x.py"), ("q", 2, "x.py"), ("q", 3, "src/a.py")], "id string, rank int, file string")
    asked = spark.createDataFrame([("q", ["a.py"]), ("none", ["b.py"])], "id string, expected_files array<string>")
    got = {r.id: r for r in metrics.retrieval_metrics(hits, asked).collect()}
    assert got["q"].hit_1 == 0 and got["q"].hit_3 == 1 and got["q"].rr == 0.5 and got["none"].rr == 0
    lat = metrics.latency(spark.createDataFrame([("a", float(i)) for i in range(11)], "system string, wall_ms double"), ["system"]).first()
    assert (lat.p50, lat.p95) == (5.0, 10.0)
