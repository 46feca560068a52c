"""Sources, planner and streams over a small invented repository."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sievemill.plans import cli, planner
from sievemill.sources import extract, repo, sinks
from sievemill.streaming import watch

FILES = {
    "src/store.py": "import json\n\nclass Store:\n    def save(self, item):\n        return self._write(item)\n\n    def _write(self, item):\n        def inner():\n            encode(item)\n        inner()\n\ndef encode(item):\n    return json.dumps(item)\n",
    "src/app.py": "from store import Store\n\ndef main():\n    s = Store()\n    s.save(1)\n",
    "svc/server.go": 'package svc\n\nimport "fmt"\n\ntype Server struct{}\n\nfunc (s *Server) Start() {\n\tfmt.Println(helper())\n}\n\nfunc helper() string { return "x" }\n',
    "lib/core.rs": "use std::fmt;\n\npub struct Core;\n\nimpl Core {\n    pub fn run(&self) { step(); }\n}\n\nfn step() {}\n",
    "web/view.ts": "import { api } from './api';\nexport class View {\n  render(): void {\n    draw();\n  }\n}\nexport const draw = () => { api(); };\n",
    "pkg/tests/test_store.py": "def test_save():\n    assert Store().save(1)\n",
    "README.md": "# Demo\nThe store saves items.\n",
    "package.json": '{"dependencies": {"react": "1"}}',
    "dist/bundle.js": "var x;",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    (base / "logo.bin").write_bytes(b"\0\1")
    return str(base)


@pytest.fixture(scope="module")
def index(spark, root):
    files = repo.parseable(repo.scan(spark, root)).persist()
    ix = planner.build_index(files)
    return planner.Index(ix.files, ix.symbols.persist(), ix.edges.persist(), ix.chunks.persist(), ix.vectors.persist())


def test_scan(spark, root):
    files = repo.scan(spark, root)
    got = {r.path: r for r in files.collect()}
    assert "dist/bundle.js" not in got and got["logo.bin"].content is None and got["src/app.py"].language == "python"
    assert repo.stats(files).first().test == 1
    assert [r.name for r in repo.dependencies(files).collect()] == ["react"]
    changed = repo.refresh(files.withColumn("content_hash", F.when(F.col("path") == "src/app.py", "old").otherwise(F.col("content_hash"))), spark.createDataFrame([("./src/app.py",), ("../x",), ("gone.py",), ("README.md",)], "path string"), files)
    assert {r.path: r.change for r in changed.collect()} == {"src/app.py": "changed", "README.md": "same"}


def test_decode(spark):
    df = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("é".encode("utf-16")),), (bytearray(b"\xe9"),)], "b binary")
    assert [r[0] for r in df.select(repo.decode("b")).collect()] == ["é"] * 3
    assert [r[0] for r in spark.createDataFrame([(bytearray(b"a\0"),), (bytearray(b"\x10\x01"),)], "b binary").select(repo.is_text("b")).collect()] == [False, True]


def test_symbols_in_five_languages(index):
    got = {(r.name, r.kind, r.language) for r in index.symbols.collect()}
    assert {("Store", "class", "python"), ("save", "method", "python"), ("Server", "struct", "go"), ("Start", "method", "go"), ("helper", "function", "go"), ("Core", "struct", "rust"), ("run", "method", "rust"), ("View", "class", "typescript"), ("render", "method", "typescript"), ("draw", "function", "typescript")} <= got


def test_calls_belong_to_the_innermost_function(index):
    ids = {r.id: r.qualified_name for r in index.symbols.collect()}
    calls = {(ids.get(r.caller_symbol_id), r.callee_name) for r in index.edges.collect()}
    assert ("Store._write.inner", "encode") in calls and ("Core.run", "step") not in calls or ("Core::run", "step") in calls
    assert ("Store", "encode") not in calls and sum(c[1] == "draw" for c in calls) == 1


def test_broken_file_keeps_what_it_had(spark):
    rows = lambda text: extract.parse_files(spark.createDataFrame([("a.py", "python", text)], "path string, language string, content string"))
    kept = extract.keep_last_good(rows("def f(): pass"), rows("def ("))
    assert [s.name for s in kept.first().symbols] == ["f"]


def test_search(index):
    assert planner.search(index, "where is encode defined").first().file == "src/store.py"
    assert planner.search(index, "README.md").count() == 0  # only parsed files are indexed
    assert planner.search(index, "store.py").first().file == "src/store.py"
    assert "src/store.py" in planner.search_pack(index, "how does the store save items in json").first().markdown


def test_dependency_and_tests(index):
    assert {r.file for r in planner.dependency(index, "encode").collect()} == {"src/store.py"}
    assert planner.tests(index, "save").first().file == "pkg/tests/test_store.py"
    assert planner.direction("anything") == "callers" and planner.direction("Callees") == "callees"
    assert planner.status(index).first().symbols > 8


def test_same_answer_again(index):
    runs = {tuple(r.file for r in planner.search(index, "how is the store saving json items").collect()) for _ in range(3)}
    assert len(runs) == 1


def test_cli_arguments():
    a = cli.settings(["search", "x", "--max-results", "3"])
    assert (a.verb, a.budget, a.max_results) == ("search", 10_000, 3)


def test_generations_and_sinks(spark, tmp_path):
    g = sinks.Generations(spark, f"{tmp_path}/store")
    assert g.current() == 0
    assert g.publish({"t": spark.range(2)}) == 1 and g.publish({"t": spark.range(5)}) == 2
    assert g.read("t").count() == 5
    sinks.write_single(spark.range(3), f"{tmp_path}/out", "json")
    assert spark.read.json(f"{tmp_path}/out").count() == 3


EVENTS = [("r", dt.datetime(2024, 1, 1, 0, 0, 0, i * 50_000), "modify", p, False) for i, p in enumerate(["a", "a", "b", "a"])]


def test_coalescing_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, watch.FS_EVENTS)
    df.write.parquet(f"{tmp_path}/in")
    stream = watch.coalesced(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    watch.run_once(stream, None, f"{tmp_path}/cp", "coalesced_test", "update")
    got = sorted(map(str, spark.table("coalesced_test").collect()))
    assert got == sorted(map(str, watch.coalesced(df).collect()))
    kinds = spark.createDataFrame([("access", "a", False), ("modify", ".gitignore", False), ("modify", "a", False), ("overflow", None, False)], "kind string, path string, is_dir boolean")
    assert [r[0] for r in kinds.select(watch.event_class()).collect()] == ["noop", "unknown", "paths", "unknown"]


def test_dirty_state_machine(spark, tmp_path):
    step = watch.dirty_step
    assert step("clean", [], 0, [("modify", "a", False, None)], 2) == ("paths", ["a"], 1)
    assert step("paths", ["a"], 1, [("ack", None, False, 1)], 2) == ("clean", [], 1)
    assert step("paths", ["a"], 2, [("ack", None, False, 1)], 2)[0] == "paths"  # stale acknowledgement
    assert step("paths", ["a", "b"], 2, [("modify", "c", False, None)], 2)[0] == "unknown"
    df = spark.createDataFrame([(*e, None) for e in EVENTS], watch.FS_EVENTS + ", seen long")
    df.write.parquet(f"{tmp_path}/in")
    watch.run_once(watch.track_dirty(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), None, f"{tmp_path}/cp", "dirty_test", "update")
    r = spark.table("dirty_test").first()
    assert (r["mode"], r.paths, r.epoch) == ("paths", ["a", "b"], 4)


def test_incremental_maintenance(spark, tmp_path):
    files = spark.createDataFrame([(n, "python", t) for n, t in FILES.items() if n.endswith(".py")], "path string, language string, content string")
    tables = lambda f: extract.tables(extract.parse_files(f))
    t = tables(files)
    from sievemill.operators import graph

    g = sinks.Generations(spark, f"{tmp_path}/gen")
    g.publish({**{k: t[k] for k in ("symbols", "refs", "imports", "files")}, "edges": graph.resolve_edges(t["refs"], t["symbols"])})
    batch = spark.createDataFrame([("src/app.py", "python", "def start():\n    encode(2)\n", 1), ("src/store.py", "python", FILES["src/store.py"], 1)], "path string, language string, content string, seq int")
    watch.maintain(g.publish, g.read, tables)(batch, 0)
    names = {r.name for r in g.read("symbols").collect()}
    assert "start" in names and "main" not in names and "Store" in names
    fresh = graph.resolve_edges(g.read("refs"), g.read("symbols"))
    assert sorted(map(str, g.read("edges").select(*fresh.columns).collect())) == sorted(map(str, fresh.collect()))
