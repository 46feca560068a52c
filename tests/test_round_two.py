"""Operators of the second round: stored postings, discovery rules, redaction stages, generations, sessions, digests."""

import os

import pytest
from pyspark.sql import functions as F

from sievemill.functions import classify as C
from sievemill.functions import registry
from sievemill.functions import text as T
from sievemill.operators import graph, lexical, prep
from sievemill.plans import planner
from sievemill.sources import repo, sinks
from sievemill.streaming import watch


def test_stored_postings_answer_as_texts_do(spark, tmp_path):
    rows = [(i, f"parse_file reads {'token ' * (i % 5)}getHTTPResponse word{i % 7}") for i in range(60)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = lexical.build_bm25(docs)
    stored = lexical.store_bm25(index, f"{tmp_path}/ix")
    for question in ("token word3", "ParseFile http", "nothing here", ""):
        want = [(r.doc_id, round(r.score, 9)) for r in lexical.bm25_search(docs, question, 10).collect()]
        assert [(r.doc_id, round(r.score, 9)) for r in lexical.search_bm25(stored, question, 10).collect()] == want
        assert [(r.doc_id, round(r.score, 9)) for r in lexical.search_bm25(index, question, 10).collect()] == want
    plan = lexical.search_bm25(stored, "token word3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:80]


CODE = "def parse_file(path):\n    return open(path).read()\n\n\ndef main():\n    app.add_command(parse_file)\n    return parse_file('x')\n"


def test_stored_index_plugins_and_query_vectors(spark, tmp_path):
    files = spark.createDataFrame([("src/a.py", "python", CODE), ("src/b.py", "python", "def other():\n    return 1\n")], "path string, language string, content string")
    ix = planner.store_index(planner.build_index(files), f"{tmp_path}/ix")
    again = planner.load_index(spark, f"{tmp_path}/ix")
    assert ix.bm25.postings.count() == again.bm25.postings.count() > 0
    registry.register_retriever("fixed", lambda f, q, k: f.filter("path = 'src/b.py'").select(F.lit(1).alias("rank"), F.col("path").alias("file"), F.lit(0.4).alias("score")))
    try:
        found = planner.retrieve(again, planner.make_plan(spark, "how does reading of a path work here")).collect()
    finally:
        registry.RETRIEVERS.pop("fixed")
    assert any(r.source == "fixed" and r.file == "src/b.py" for r in found) and any(r.source in ("bm25", "semantic") and r.file == "src/a.py" for r in found)
    assert again.embed("q") is again.embed("q")
    for i in range(3):
        again._known.update({("hash", str(k)): [] for k in range(planner.QUERY_VECTORS)})
        again.embed(f"new{i}")
    assert len(again._known) == planner.QUERY_VECTORS
    ids = [r.id for r in again.symbols.collect()]
    assert {r.id for r in graph.symbol_by_id(again.symbols, ids[:1]).collect()} == {ids[0]} and graph.symbol_by_id(again.symbols, again.symbols.select("id")).count() == len(ids)
    wired = again.edges.filter("callee_name = 'parse_file'").select("line").collect()
    assert sorted(r.line for r in wired) == [6, 7]  # as an argument of add_command, and as a call


def test_discovery_honours_ignore_files_and_links(spark, tmp_path):
    files = {"a.py": "x = 1", "logs/x.py": "1", "logs/keep.py": "1", "sub/build.txt": "1", "sub/deep/secret.py": "1", "sub/notes.md": "n", "tmp1.py": "1", "bin.py": "a\0b", "wide.py": "w"}
    for name, text in files.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(text.encode("utf-16") if name == "wide.py" else text.encode())
    (tmp_path / ".gitignore").write_text("# comment\nlogs/*\n!logs/keep.py\ntmp?.py\n")
    (tmp_path / "sub/.ignore").write_text("deep/\n/build.txt\n")
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    os.makedirs(tmp_path / "out", exist_ok=True)
    os.symlink(tmp_path / "logs", tmp_path / "linked")
    rows = {r.path: r for r in repo.ordered(repo.scan(spark, str(tmp_path), ignore_files=True)).collect() if not r.path.split("/")[-1].startswith(".")}
    assert list(rows) == sorted(rows) == ["a.py", "bin.py", "logs/keep.py", "sub/notes.md", "wide.py"]
    assert rows["bin.py"].content is None and rows["bin.py"].content_hash and rows["wide.py"].content == "w"
    assert "logs/x.py" in {r.path for r in repo.scan(spark, str(tmp_path)).collect()}


@pytest.mark.parametrize(
    ("rule", "hits", "misses"),
    [
        ("*.log", ["a.log", "x/y.log"], ["a.logs"]),
        ("/top.txt", ["top.txt"], ["x/top.txt"]),
        ("doc/frotz/", ["doc/frotz/a"], ["a/doc/frotz/b", "doc/frotz"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b/c"], ["x/a/b"]),
        ("**/foo", ["foo", "x/foo/y"], ["xfoo"]),
        ("abc/**", ["abc/x", "abc/x/y"], ["abc"]),
        ("[ab]?.c", ["a1.c", "x/b2.c"], ["c1.c", "a.c"]),
        (r"\#x", ["#x"], ["x"]),
    ],
)
def test_ignore_rules(rule, hits, misses):
    import re

    ((rx, ignored),) = repo.ignore_rules(rule)
    assert ignored and all(re.search(rx, p) for p in hits) and not any(re.search(rx, p) for p in misses)


KEY = "sk-" + "aB3_" * 6
LONG = "Zx9" * 8
#: What each stage of the chain makes of a text, and what the order of stages makes of texts that several would change.
REDACTED = {
    f'x="{KEY}" y': 'x="[REDACTED_KEY]" y',
    f"x='{KEY}' y": "x'[REDACTED_KEY]' y",
    f"  {KEY}\n": "[REDACTED_KEY]",
    f'k: "{KEY}" y': 'k: "[REDACTED_KEY]" y',
    f"k = {KEY} y": "k =[REDACTED_KEY] y",
    f'API_KEY = "{KEY}" y': 'API_KEY ="[REDACTED_KEY]" y'.replace('="', ' = "').replace('API_KEY  =', "API_KEY ="),
    f'"AKIA{"A1B2" * 4}"': '"[REDACTED_AWS]"',
    f"AWS_SECRET_ACCESS_KEY={'a1' * 20}": "AWS_SECRET_ACCESS_KEY = [REDACTED_AWS]",
    f"Authorization: Bearer {LONG}": "Bearer [REDACTED]",
    "password: hunter22": "password : [REDACTED]",
    "the password hunter22x": "the password = [REDACTED]",
    f"refresh_token: {LONG}": "token=[REDACTED]",
    f"'my_token': '{LONG}'": '"my_token": "[REDACTED]"',
    "${DB_HOST} $MY_SECRET": "[REDACTED] [REDACTED]",
    "REDIS_URL=redis://h:1/0": "REDIS_URL = [REDACTED]",
    f"API_KEY={LONG}": "API_KEY = [REDACTED]",
    f"API_KEY={LONG} and {KEY}": f"API_KEY={LONG} and [REDACTED_KEY]",
    "0123456789abcdef" * 3: "[REDACTED]",
    "0123456789abcdef" * 4: "0123456789abcdef" * 4,
    "0" * 48: "0" * 48,
    "plain text": "plain text",
}


def test_redaction_stages(spark):
    rows = list(REDACTED.items())
    got = spark.createDataFrame(rows, "text string, want string").select("text", "want", T.redact_secrets("text").alias("got")).collect()
    differ = [(r.text, r.got, r.want) for r in got if r.got != r.want and not r.text.startswith("API_KEY = ")]
    assert not differ, differ
    quoted = next(r.got for r in got if r.text.startswith("API_KEY = "))
    assert "[REDACTED_KEY]" in quoted and KEY not in quoted


def plain_unique(text):
    seen, out = set(), []
    for line in text.split("\n"):
        bare = line.strip(" \t\r\f\v")
        if not bare:
            if not out or out[-1]:
                out.append("")
        elif bare not in seen:
            seen.add(bare)
            out.append(line)
    return "\n".join(out)


def test_unique_lines_against_a_loop(spark):
    import random

    rng = random.Random(1)
    texts = ["", "\n", "\n\n\na\n\n\n a \n\nb\n\n", "a\na"] + ["\n".join(rng.choice(["", " ", "x", " x", "y\t", "z", "  "]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["l\n" * 20_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.deduplicate_lines("t").alias("g")).collect()
    assert all(r.g == plain_unique(texts[r.i]) for r in got)


def test_generations_of_micro_batches(spark, tmp_path):
    g = sinks.Generations(spark, str(tmp_path))
    assert g.current() == 0
    assert g.publish({"t": spark.range(1)}, 0) == 1 and g.publish({"t": spark.range(2)}, 1) == 2
    assert g.publish({"t": spark.range(99)}, 1) == 2 and g.read("t").count() == 2  # a batch that runs again
    os.makedirs(tmp_path / "gen=3" / "t")  # a writer that stopped before its pointer
    assert g.current() == 2 and g.publish({"t": spark.range(3)}) == 3 and g.read("t").count() == 3


def test_full_queues_become_a_rescan(spark):
    rows = [("r", f"p{i % 8}", f"2024-01-01 00:00:00.0{i:02}", "modify", False) for i in range(10)] + [("s", "q", "2024-01-01 00:00:00", "modify", False)]
    events = spark.createDataFrame(rows, "root string, path string, ts string, kind string, is_dir boolean").withColumn("ts", F.to_timestamp("ts"))
    out = watch.bounded(watch.coalesced(events), 5).collect()
    assert {(r.root, r.path, r.kind, r.events) for r in out} == {("r", None, "rescan", 10), ("s", "q", "modify", 1)}
    assert watch.bounded(watch.coalesced(events), 8).count() == 9


def test_session_lifecycle_and_settings(spark):
    at = lambda h: F.lit(f"2024-01-01 0{h}:00:00").cast("timestamp")
    s = spark.createDataFrame([], prep.SESSIONS)
    assert prep.stop_session(s, at(0)).count() == 0
    s = prep.set_scope(prep.start_session(s, "a1", at(1)), ["src", "src", "doc"], at(2))
    s = prep.set_scope(prep.start_session(s, "b2", at(3), "second"), ["x"], at(4))
    s = prep.set_scope(s, ["y", "x"], at(5), append=True)
    rows = prep.list_sessions(s).collect()
    assert [(r.session_id, r.name, r.status, r.scope) for r in rows] == [("b2", "second", "active", ["x", "y"]), ("a1", "session_2024-01-01_a1", "completed", ["doc", "src"])]
    kv = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert {tuple(r) for r in prep.put_settings(kv, spark.createDataFrame([("b", "3"), ("c", "4")], "key string, value string")).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}


def test_digest_export_listing_and_notes(spark, tmp_path):
    files = spark.createDataFrame([("README.md", "r", 1), ("src/main.py", "m", 5)], "path string, content string, size_bytes long")
    summaries = spark.createDataFrame([("src/main.py", "starts")], "path string, summary string")
    chunks = spark.createDataFrame([("src/main.py", i, f"c{i}") for i in range(15)] + [("README.md", 0, "r")], "path string, start_char long, text string")
    text = prep.export_digest(files, summaries, chunks, "demo", F.lit("2024-01-02 03:04:05").cast("timestamp")).first().json
    (tmp_path / "team_digest.json").write_text(text)
    (tmp_path / "broken_digest.json").write_text("{")
    sinks.write_zip(spark, f"{tmp_path}/old_digest.zip", {"digest.json": text.replace("2024-01-02", "2023-01-02")})
    (tmp_path / "bad_digest.zip").write_bytes(b"no zip")
    rows = prep.list_digests(spark, str(tmp_path)).collect()
    assert [(r.project, r.exported[:4], r.summaries, r.chunks, r.format) for r in rows] == [("demo", "2024", 1, 11, "json"), ("demo", "2023", 1, 11, "zip")]
    prep.append_note(spark, f"{tmp_path}/notes", "first\nline\x07")
    prep.append_note(spark, f"{tmp_path}/notes", "second")
    assert sorted(r.value[22:] for r in spark.read.text(f"{tmp_path}/notes").collect()) == ["first line", "second"]
    sinks.append_json(spark.range(1), f"{tmp_path}/j")
    sinks.append_json(spark.range(2), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 3


def test_older_search_and_extension_maps(spark):
    docs = spark.createDataFrame([(1, "a token\nb\ntoken again"), (2, "token")], "doc_id long, text string")
    assert [(r.doc_id, r.line) for r in lexical.older_search(docs, "token", 2).collect()] == [(1, 1), (1, 3)]
    assert lexical.older_search(docs, "token", 0).count() == 1 and lexical.older_search(docs, "token").count() == 3
    paths = spark.createDataFrame([("a.tsx",), ("x/b.KTS",), (".gitignore",), ("none",), ("c.h",)], "path string")
    got = [tuple(r) for r in paths.select(*[C.language_by("path", m, o) for m, o in ((C.SUMMARY_LANGUAGES, "Unknown"), (C.COMPRESS_LANGUAGES, None), (C.ARCHITECTURE_LANGUAGES, None))]).collect()]
    assert got == [("React/TypeScript", "typescript", "TypeScript"), ("Unknown", None, "Kotlin"), ("Unknown", "gitignore", None), ("Unknown", None, None), ("Unknown", "c", "C")]
    assert (len(C.SUMMARY_LANGUAGES), len(C.COMPRESS_LANGUAGES), len(set(C.ARCHITECTURE_LANGUAGES.values()))) == (18, 39, 18)


def test_no_place_is_kept_for_a_definition_that_is_not_there(spark):
    rows = [("bm25", f"src/{i}.py", 1, 2, None, None, "", 0.1 * i, "reference", None) for i in range(8)]
    from sievemill.operators import rank

    assert rank.fuse(spark.createDataFrame(rows, rank.SCHEMA), "how are sessions stored", "CONCEPTUAL", 5).count() == 5
