"""Document preparation and project analytics: chunks, bundles, summaries, notes, digests, status."""

from __future__ import annotations

import ast
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import classify as C
from ..functions import text as T

BREAKS = ["\n\n", "\n", ". ", "; ", " "]


def chunk_stride(docs: DataFrame, size: int = 1000, overlap: int = 100, *, key: str = "doc_id") -> DataFrame:
    """Fixed windows of characters: key, chunk_index, start_char, end_char, text. Built-in expressions only."""
    step, n = size - overlap, F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(step))
    rows = docs.filter("text is not null and text != ''").select(key, F.col("text").alias("_t"), n.alias("_n"), F.posexplode(starts).alias("chunk_index", "start_char"))
    end = F.least(F.col("start_char") + size, F.col("_n"))
    return rows.select(key, F.col("chunk_index").cast("long"), F.col("start_char").cast("long"), end.cast("long").alias("end_char"), F.expr(f"substring(_t, start_char + 1, {size})").alias("text"))


def _windows(text: str, size: int, overlap: int):
    start, n = 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            for mark in BREAKS:
                at = text.rfind(mark, start + size // 2, end)
                if at >= 0:
                    end = at + len(mark)
                    break
        yield start, end
        if end == n:
            return
        start = max(start + 1, end - overlap)


def chunk_breaks(docs: DataFrame, size: int = 1000, overlap: int = 100, *, key: str = "doc_id") -> DataFrame:
    """Windows that end at a paragraph, line, sentence, clause or word past their middle; no tail of one-character steps."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [(k, i, a, b, t[a:b]) for k, t in zip(pdf[key], pdf["text"], strict=True) if t for i, (a, b) in enumerate(_windows(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "start_char", "end_char", "text"])

    return docs.select(key, "text").mapInPandas(run, f"{key} {kind}, chunk_index long, start_char long, end_char long, text string")


def add_chunk_ids(chunks: DataFrame, *, key: str = "doc_id") -> DataFrame:
    h = T.content_hash("text")
    return chunks.withColumn("content_hash", h).withColumn("chunk_id", T.key_hash(F.col(key), F.col("start_char"), F.col("end_char"), F.col("content_hash")))


# --- code summaries ----------------------------------------------------------------------------------------------------


def python_api(code: str) -> str:
    """Signatures and docstrings of a module; empty for code that does not parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return ""
    out = [f'"""{ast.get_docstring(tree)}"""'] if ast.get_docstring(tree) else []

    def walk(nodes, depth):
        for node in nodes:
            if isinstance(node, ast.ClassDef):
                bases = f"({', '.join(map(ast.unparse, node.bases))})" if node.bases else ""
                head = f"class {node.name}{bases}:"
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                head = f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)}):"
            else:
                continue
            out.append("    " * depth + head)
            if doc := ast.get_docstring(node):
                out.append("    " * (depth + 1) + f'"""{doc}"""')
            if isinstance(node, ast.ClassDef):
                walk(node.body, depth + 1)

    walk(tree.body, 0)
    return "\n".join(out)


JS_SURFACE = re.compile(r"(/\*\*(?:[^*]|\*(?!/))*\*/\s*)?^[ \t]*((?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?\s+\w+\s*\([^)]*\)|class\s+\w+(?:\s+extends\s+[\w.]+)?|const\s+\w+\s*=\s*(?:async\s*)?\([^)]*\)\s*=>))", re.M)


def javascript_api(code: str) -> str:
    return "\n".join((doc or "").strip() + "\n" * bool(doc) + head.strip() for doc, head in JS_SURFACE.findall(code))


def summarise_file(path: str, code: str) -> dict:
    """Purpose, surface, dependencies, risks and structure of one file; unknown languages get line counts."""
    ext = path.rpartition(".")[2].lower()
    lines = code.split("\n")
    purpose, surface, deps, shape = "", [], [], {"lines": len(lines)}
    if ext == "py":
        try:
            tree = ast.parse(code)
            purpose = (ast.get_docstring(tree) or "").split("\n")[0]
            surface = [n.name for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and not n.name.startswith("_")]
            deps = sorted({a.name.split(".")[0] for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names} | {n.module.split(".")[0] for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module})
            shape |= {"classes": sum(isinstance(n, ast.ClassDef) for n in ast.walk(tree)), "functions": sum(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) for n in ast.walk(tree))}
        except (SyntaxError, ValueError):
            shape["unparsed"] = 1
    elif ext in ("js", "jsx", "ts", "tsx", "mjs", "cjs"):
        surface = sorted(set(re.findall(r"export\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|interface|type)\s+(\w+)", code)))
        deps = sorted(set(re.findall(r"""(?:from|require\()\s*['"]([^'"]+)['"]""", code)))
    elif ext in ("java", "kt"):
        surface = re.findall(r"public\s+(?:static\s+|final\s+|abstract\s+)*(?:class|interface|enum|record)\s+(\w+)", code)
        deps = sorted(set(re.findall(r"^import\s+(?:static\s+)?([\w.]+)", code, re.M)))
    risks = [name for name, rx in (("eval", r"\beval\("), ("exec", r"\bexec\("), ("shell", r"shell\s*=\s*True|os\.system"), ("broad except", r"except\s*:|except Exception")) if re.search(rx, code)]
    return {"path": path, "purpose": purpose, "surface": surface, "dependencies": deps, "risks": risks, "structure": {k: int(v) for k, v in shape.items()}}


SUMMARY = "path string, purpose string, surface array<string>, dependencies array<string>, risks array<string>, structure map<string,int>"


def summarise_files(files: DataFrame) -> DataFrame:
    """``files(path, content)`` to summaries, a row each."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([summarise_file(p, c or "") for p, c in zip(pdf["path"], pdf["content"], strict=True)], columns=[f.split()[0] for f in SUMMARY.split(", ")])

    return files.select("path", "content").mapInPandas(run, SUMMARY)


def compress_code(files: DataFrame, compressor=None) -> DataFrame:
    """``files(path, content)`` less skipped ones: redacted, to API surface or stripped text, with the ratio of sizes.

    ``compressor(text, language) -> text`` replaces the built-in step; an exception in it keeps the redacted text.
    """
    kept = files.filter(~C.is_skipped("path")).select("path", "content", C.detect_language("path").alias("language"), T.redact_secrets("content").alias("redacted"))

    def run(batches):
        for pdf in batches:
            out = []
            for text, language in zip(pdf["redacted"], pdf["language"], strict=True):
                try:
                    if compressor:
                        out.append(compressor(text, language))
                    else:
                        api = python_api(text) if language == "python" else javascript_api(text) if language in ("javascript", "typescript") else ""
                        out.append(api or text)
                except Exception:  # noqa: BLE001  a plug-in must not end the job
                    out.append(text)
            yield pdf.assign(short=out)[["path", "language", "content", "short"]]

    made = kept.mapInPandas(run, "path string, language string, content string, short string")
    return made.select("path", "language", T.compress_whitespace("short").alias("compressed"), F.octet_length("content").cast("long").alias("original_bytes")).withColumn(
        "ratio", F.round(F.octet_length("compressed") / F.greatest(F.col("original_bytes"), F.lit(1)), 6)
    )


def todo_profile(files: DataFrame) -> DataFrame:
    """Marker counts, keyword flags and recommendations of ``files(path, content)``."""
    c = F.coalesce("content", F.lit(""))
    n = {m.lower(): F.regexp_count(c, F.lit(m)).cast("long") for m in ("TODO", "FIXME", "XXX")}
    low = F.lower(c)
    flags = {"uses_network": "http://|https://|requests\\.|fetch\\(", "uses_database": "select |insert |sqlite|postgres", "has_tests": "def test_|describe\\(|#\\[test\\]"}
    made = files.select("path", *[v.alias(k) for k, v in n.items()], *[low.rlike(rx).alias(k) for k, rx in flags.items()], F.length(c).cast("long").alias("chars"))
    return made.withColumn(
        "recommendations",
        F.array_compact(F.array(F.when(F.col("fixme") > 0, "resolve FIXME markers"), F.when(F.col("todo") > 5, "plan the open TODO markers"), F.when(F.col("chars") > 50_000, "split the file"), F.when(~F.col("has_tests"), "add tests"))),
    )


def select_files(files: DataFrame, keywords: list[str], limit: int = 20) -> DataFrame:
    """The best ``limit`` of ``files(path, content, mtime)`` by keywords in path (3) and content (1), kind and recency."""
    low, body = F.lower("path"), F.lower(F.coalesce("content", F.lit("")))
    points = F.lit(0)
    for k in keywords:
        points = points + F.when(low.contains(k.lower()), 3).otherwise(0) + F.when(body.contains(k.lower()), 1).otherwise(0)
    points = points + F.when(C.classify_path("path") == "source", 2).otherwise(0)
    return files.withColumn("points", points).filter("points > 0").orderBy(F.desc("points"), F.desc_nulls_last("mtime"), "path").limit(limit)


# --- bundles, notes, digests, status -----------------------------------------------------------------------------------

SECTIONS = ["Architecture", "API", "Configuration", "Documentation", "Session", "Cross-cutting", "Expanded", "Notes"]


def bundle(sections: DataFrame) -> DataFrame:
    """``sections(ord, title, body)`` to one markdown text in fixed order: redacted, deduplicated, ``None`` for empty bodies.

    A bundle has a handful of sections; they are the bounded group.
    """

    def once(batches):
        for pdf in batches:
            yield pdf.assign(body=pdf["body"].map(T.unique_lines))

    clean = sections.select(F.col("ord").cast("int"), "title", T.compress_whitespace(T.redact_secrets("body")).alias("body"))
    sections, body = clean.mapInPandas(once, "ord int, title string, body string"), F.col("body")
    part = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.when(F.trim(body) == "", "None").otherwise(body))
    made = sections.select("ord", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("ord", "part"))).alias("x"))
    text = F.array_join(F.col("x.part"), "\n\n")
    return made.select(text.alias("markdown"), T.token_estimate(text).alias("tokens"))


def render_note(notes: DataFrame) -> DataFrame:
    """Note rows to markdown; the inverse of ``parse_note``."""
    bullets = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)), "\n")
    text = F.concat(
        F.lit("# Handoff\n\nSession: "), "session_id", F.lit("\nDate: "), F.date_format("created", "yyyy-MM-dd HH:mm:ss"), F.lit("\n\n## Summary\n"), "summary",
        F.lit("\n\n## Next steps\n"), bullets("next_steps"), F.lit("\n\n## Blockers\n"), bullets("blockers"), F.lit("\n\n## Files\n"), bullets("files_modified"), F.lit("\n"),
    )
    return notes.select("filename", text.alias("text"))


def parse_note(notes: DataFrame) -> DataFrame:
    part = lambda name: F.regexp_extract("text", rf"(?s)## {name}\n(.*?)\n*(?=\n## |\z)", 1)
    items = lambda name: F.transform(F.filter(F.split(part(name), "\n"), lambda x: x.startswith("- ")), lambda x: F.substring(x, F.lit(3), F.length(x)))
    return notes.select(
        "filename",
        F.regexp_extract("text", r"Session: ([^\n]*)", 1).alias("session_id"),
        F.try_to_timestamp(F.regexp_extract("text", r"Date: ([^\n]*)", 1)).alias("created"),
        F.trim(part("Summary")).alias("summary"),
        items("Next steps").alias("next_steps"),
        items("Blockers").alias("blockers"),
        items("Files").alias("files_modified"),
    )


def recent_notes(notes: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    cut = (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {int(days)} DAYS")
    return notes.filter(F.col("created") >= cut).orderBy(F.desc("created"))


def search_notes(notes: DataFrame, query: str) -> DataFrame:
    low = query.lower()
    inside = F.exists("next_steps", lambda s: F.lower(s).contains(low)) | F.exists("blockers", lambda s: F.lower(s).contains(low))
    return notes.filter(F.lower("summary").contains(low) | inside).orderBy(F.desc("created"))


def notes_summary(notes: DataFrame) -> DataFrame:
    one = notes.agg(F.count("*").alias("notes"), F.min("created").alias("first"), F.max("created").alias("last"), F.sum(F.size("blockers")).alias("blockers"))
    files = notes.select(F.explode("files_modified").alias("f")).agg(F.count_distinct("f").alias("files"))
    return one.crossJoin(files)


def expired_notes(notes: DataFrame, keep_days: int, now: Column | None = None) -> DataFrame:
    """Notes a cleanup removes."""
    cut = (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {int(keep_days)} DAYS")
    return notes.filter(F.col("created") < cut)


def merge_digests(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """``(path, hash)`` tables to path, status (same, conflict, added, local), hash kept."""
    a, b = mine.select("path", F.col("hash").alias("h1")), theirs.select("path", F.col("hash").alias("h2"))
    j = a.join(b, "path", "full")
    status = F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "local").when(F.col("h1") == F.col("h2"), "same").otherwise("conflict")
    return j.select("path", status.alias("status"), F.coalesce("h1", "h2").alias("hash"))


def digest(files: DataFrame) -> DataFrame:
    """One row of ``files(path, content, size_bytes)``: counts by kind and language, bytes, largest files."""
    tagged = files.select("path", "size_bytes", C.classify_path("path").alias("kind"), C.detect_language("path").alias("language"))
    kinds = tagged.groupBy("kind").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    languages = tagged.groupBy("language").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))
    top = tagged.orderBy(F.desc("size_bytes"), "path").limit(10).agg(F.array_sort(F.collect_list("path")).alias("largest"))
    totals = tagged.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    return totals.crossJoin(kinds).crossJoin(languages).crossJoin(top)


def export_digest(files: DataFrame, summaries: DataFrame, chunks: DataFrame, project: str, now: Column, patterns: list[str] | None = None, per_pattern: int = 10) -> DataFrame:
    """One row ``json``: metadata, statistics, ``summaries(path, summary)`` and key chunks, ``per_pattern`` of ``chunks(path, start_char, text)`` for each pattern in their paths.

    Summaries come in path order; the digest of a project is one document, read and written whole.
    """
    picked = None
    for i, p in enumerate(patterns or ["readme", "main", "config", "api"]):
        some = chunks.filter(F.lower("path").contains(p)).orderBy("path", "start_char").limit(per_pattern).select(F.lit(i).alias("p"), "path", "start_char", "text")
        picked = some if picked is None else picked.unionByName(some)
    once = picked.groupBy("path", "start_char").agg(F.min("p").alias("p"), F.first("text").alias("text"))
    keys = once.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "path", "start_char", "text"))), lambda c: F.struct(c["path"].alias("path"), c["start_char"].alias("start_char"), c["text"].alias("text"))).alias("key_chunks"))
    files_ = summaries.agg(F.array_sort(F.collect_list(F.struct("path", "summary"))).alias("file_summaries"))
    meta = F.struct(F.lit(project).alias("project_name"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("export_timestamp")).alias("metadata")
    row = digest(files).crossJoin(files_).crossJoin(keys)
    statistics = F.struct("files", "bytes", "kinds", "languages", "largest").alias("statistics")
    return row.select(F.to_json(F.struct(meta, statistics, "file_summaries", "key_chunks")).alias("json"))


def list_digests(spark, folder: str) -> DataFrame:
    """The digests below ``folder``, JSON or ZIP (``digest.json`` inside), newest first: path, project, exported, size, summaries, chunks, format.

    Files that can't be read as digests are left out.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*digest*.{json,zip}").option("recursiveFileLookup", "true").load(folder)

    def unpacked(batches):
        for pdf in batches:
            texts = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    texts.append(zipfile.ZipFile(io.BytesIO(content)).read("digest.json").decode() if path.endswith(".zip") else bytes(content).decode())
                except (zipfile.BadZipFile, KeyError, UnicodeDecodeError):
                    texts.append(None)
            yield pdf[["path", "length"]].assign(text=texts)

    parts = "metadata struct<project_name: string, export_timestamp: string>, file_summaries array<struct<path: string>>, key_chunks array<struct<path: string>>"
    d = raw.mapInPandas(unpacked, "path string, length long, text string").withColumn("d", F.from_json("text", parts)).filter("d.metadata is not null")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    out = d.select("path", F.col("d.metadata.project_name").alias("project"), F.col("d.metadata.export_timestamp").alias("exported"), F.col("length").alias("size"), count(F.col("d.file_summaries")).alias("summaries"), count(F.col("d.key_chunks")).alias("chunks"), F.when(F.col("path").endswith(".zip"), "zip").otherwise("json").alias("format"))
    return out.orderBy(F.desc("exported"), "path")


CHECKLIST = {"README": r"(?i)(^|/)readme(\.[a-z]+)?$", "Architecture": r"(?i)(^|/)(architecture|adr|design)[^/]*(\.md|/)", "API": r"(?i)(^|/)(api|apis|openapi)[^/]*\.(md|ya?ml|json)$", "Changelog": r"(?i)(^|/)(changelog|history)[^/]*$", "License": r"(?i)(^|/)licen[sc]e[^/]*$"}


def checklist(files: DataFrame) -> DataFrame:
    """Documentation groups of ``files(path)``: group, found, n, first three paths. Each group's list is cut inside the aggregate's input."""
    pairs = F.filter(F.array(*[F.when(F.col("path").rlike(rx), F.lit(name)) for name, rx in CHECKLIST.items()]), lambda g: g.isNotNull())
    rows = files.select("path", F.explode(pairs).alias("group"))
    n = rows.groupBy("group").agg(F.count("*").alias("n"))
    few = rows.withColumn("r", F.row_number().over(W.partitionBy("group").orderBy("path"))).filter("r <= 3").groupBy("group").agg(F.array_sort(F.collect_list("path")).alias("first"))
    names = files.sparkSession.createDataFrame([(g,) for g in CHECKLIST], "group string")
    return names.join(n, "group", "left").join(few, "group", "left").select("group", (F.coalesce("n", F.lit(0)) > 0).alias("found"), F.coalesce("n", F.lit(0)).alias("n"), "first")


def conflict_markers(files: DataFrame) -> DataFrame:
    c = F.col("content")
    return files.filter(c.contains("<<<<<<< ") | c.contains("\n=======\n") | c.contains(">>>>>>> ")).select("path")


def change_set(vcs: DataFrame, known: DataFrame, current: DataFrame) -> DataFrame:
    """Paths to index again: those a version control system names, and those whose hash is new or differs."""
    hashed = current.join(known.select("path", F.col("hash").alias("old")), "path", "left").filter(~F.col("hash").eqNullSafe(F.col("old"))).select("path")
    return vcs.select("path").union(hashed).distinct()


def stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored rows with a flag: the hash on disk differs; a path that is unknown there is not stale."""
    j = stored.join(current.select("path", F.col("hash").alias("now")), "path", "left")
    return j.withColumn("stale", F.coalesce(F.col("hash") != F.col("now"), F.lit(False))).drop("now")


def add_baselines(files: DataFrame, max_bytes: int = 10 << 20) -> DataFrame:
    """Files that may become baselines: inside the project, of a known kind and size; redacted and hashed."""
    ok = C.normalise_path("path").isNotNull() & C.is_searchable("path") & (F.octet_length("content") <= max_bytes)
    return files.filter(ok).select("path", T.redact_secrets("content").alias("content"), T.content_hash("content").alias("hash"))


VERBS = ["Edited", "Created", "Deleted", "Moved", "Ran"]


def session_events(log: DataFrame) -> DataFrame:
    """Lines ``[HH:MM:SS] Verb detail`` to rows; other lines are dropped."""
    rx = r"^\[([0-9]{2}:[0-9]{2}:[0-9]{2})\] (" + "|".join(VERBS) + r") (.*)$"
    return log.filter(F.col("line").rlike(rx)).select("session", *[F.regexp_extract("line", rx, i).alias(n) for i, n in ((1, "at"), (2, "verb"), (3, "detail"))])


def session_summary(events: DataFrame) -> DataFrame:
    """Verb counts and the last five details of each session. Tasks count and cut to five before rows are shuffled (window group limit)."""
    counts = events.groupBy("session").agg(*[F.count_if(F.col("verb") == v).alias(v.lower()) for v in VERBS])
    rank = F.row_number().over(W.partitionBy("session").orderBy(F.desc("at"), F.desc("detail")))
    last = events.select("session", "at", "detail").withColumn("r", rank).filter("r <= 5").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("r", "detail")))["detail"].alias("last"))
    return counts.join(last, "session")


# --- sessions and settings: small state tables ------------------------------------------------------------------------------

SESSIONS = "session_id string, name string, description string, created timestamp, updated timestamp, completed timestamp, scope array<string>, status string"


def start_session(sessions: DataFrame, session_id: str, now: Column, name: str | None = None, description: str = "") -> DataFrame:
    """``sessions`` with a new active row; the one that was active is completed."""
    named = F.lit(name) if name else F.concat(F.lit("session_"), F.date_format(now, "yyyy-MM-dd"), F.lit(f"_{session_id}"))
    none = F.lit(None).cast("timestamp")
    row = sessions.sparkSession.range(1).select(F.lit(session_id).alias("session_id"), named.alias("name"), F.lit(description).alias("description"), now.alias("created"), now.alias("updated"), none.alias("completed"), F.array().cast("array<string>").alias("scope"), F.lit("active").alias("status"))
    return stop_session(sessions, now).unionByName(row)


def stop_session(sessions: DataFrame, now: Column) -> DataFrame:
    """The active session completed; without one nothing changes."""
    on = F.col("status") == "active"
    return sessions.withColumns({"completed": F.when(on, now).otherwise(F.col("completed")), "updated": F.when(on, now).otherwise(F.col("updated")), "status": F.when(on, "completed").otherwise(F.col("status"))})


def set_scope(sessions: DataFrame, paths: list[str], now: Column, *, append: bool = False) -> DataFrame:
    """Paths of the active session: set, or added to what there is, each once and in order."""
    given = F.array(*[F.lit(p) for p in paths]).cast("array<string>")
    scope = F.array_sort(F.array_distinct(F.array_union("scope", given) if append else given))
    on = F.col("status") == "active"
    return sessions.withColumns({"scope": F.when(on, scope).otherwise(F.col("scope")), "updated": F.when(on, now).otherwise(F.col("updated"))})


def list_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("created"), "session_id")


def put_settings(settings: DataFrame, more: DataFrame) -> DataFrame:
    """``(key, value)`` tables of configuration, tasks or state: rows of ``more`` replace those of their key."""
    return settings.join(more.select("key").distinct(), "key", "left_anti").unionByName(more)


def note_line(text: str, now: Column) -> Column:
    """A note as it is appended: time, then the sanitised text on one line."""
    return F.concat(F.lit("["), F.date_format(now, "yyyy-MM-dd HH:mm:ss"), F.lit("] "), T.sanitise_note(F.regexp_replace(F.lit(text), "[\\r\\n]+", " ")))


def append_note(spark, path: str, text: str, now: Column | None = None) -> None:
    """Adds a line to the notes below ``path``."""
    spark.range(1).select(note_line(text, F.current_timestamp() if now is None else now).alias("value")).coalesce(1).write.mode("append").text(path)


def session_payload(chunks: DataFrame, injected: DataFrame, scope: list[str], query: str | None = None, limit: int = 50) -> DataFrame:
    """Chunks in scope (or matching the query), and injected texts of which the last of a path counts."""
    inside = F.lit(False)
    for s in scope:
        inside = inside | F.col("path").startswith(s)
    if query:
        inside = inside | F.lower("text").contains(query.lower())
    last = injected.groupBy("path").agg(F.max_by("text", "seq").alias("text"))
    some = chunks.filter(inside).orderBy("path", "start_char").limit(limit)
    return some.select("path", "text", F.lit("chunk").alias("origin")).unionByName(last.select("path", "text", F.lit("injected").alias("origin")))


def process_match(processes: DataFrame, patterns: list[list[str]]) -> DataFrame:
    """Processes whose command holds one of the token sequences in a row: ``processes(pid, tokens)``."""
    joined = F.concat(F.lit("\x1f"), F.array_join("tokens", "\x1f"), F.lit("\x1f"))
    hit = F.lit(False)
    for p in patterns:
        hit = hit | joined.contains("\x1f" + "\x1f".join(p) + "\x1f")
    return processes.filter(hit)


# --- project summaries --------------------------------------------------------------------------------------------------

FRAMEWORKS = {"django": "Django", "flask": "Flask", "fastapi": "FastAPI", "react": "React", "vue": "Vue", "next": "Next.js", "express": "Express", "@nestjs/core": "NestJS", "spring-boot": "Spring Boot", "pytest": "pytest"}
ENTRYPOINTS = r"(^|/)(main|index|app|server|cli|manage|__main__)\.(py|js|ts|go|rs|java)$"


def architecture(files: DataFrame, dependencies: DataFrame, max_depth: int = 34) -> DataFrame:
    """One row of ``files(path)`` and ``dependencies(name)``: languages by count, frameworks, key folders (12), entry points."""
    inside = files.filter((F.size(F.split("path", "/")) <= max_depth) & ~C.is_excluded("path"))
    lang = inside.select(C.detect_language("path").alias("l")).filter("l != 'unknown'").groupBy("l").count().agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "l")))["l"].alias("languages"))
    known = F.create_map(*[F.lit(x) for kv in FRAMEWORKS.items() for x in kv])
    frame = dependencies.select(known[F.lower("name")].alias("f")).filter("f is not null").agg(F.array_sort(F.collect_set("f")).alias("frameworks"))
    top = inside.select(F.element_at(F.split("path", "/"), 1).alias("d"), F.instr("path", "/").alias("s")).filter("s > 0").groupBy("d").count().orderBy(F.desc("count"), "d").limit(12).agg(F.array_sort(F.collect_list("d")).alias("key_dirs"))
    entry = inside.filter(F.col("path").rlike(ENTRYPOINTS)).orderBy("path").limit(20).agg(F.array_sort(F.collect_list("path")).alias("entrypoints"))
    return lang.crossJoin(frame).crossJoin(top).crossJoin(entry)


HEALTH = [("readme", r"(?i)(^|/)readme", 20), ("tests", r"(?i)(^|/)(tests?|__tests__)/|_test\.|test_|\.spec\.", 25), ("ci", r"(^|/)\.github/workflows/|\.gitlab-ci\.yml$|Jenkinsfile$", 20), ("license", r"(?i)(^|/)licen[sc]e", 10), ("lockfile", r"(package-lock\.json|Cargo\.lock|poetry\.lock|go\.sum|yarn\.lock)$", 10), ("docs", r"(?i)(^|/)docs?/", 15)]


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def project_health(files: DataFrame) -> DataFrame:
    """One row: a flag for each sign, the weighted score and its grade."""
    flags = files.agg(*[F.coalesce(F.max(F.col("path").rlike(rx)), F.lit(False)).alias(n) for n, rx, _ in HEALTH])
    score = sum(F.when(F.col(n), w).otherwise(0) for n, _, w in HEALTH)
    return flags.withColumn("score", score).withColumn("grade", grade(F.col("score")))


def status_report(**tables: DataFrame) -> DataFrame:
    """One row: the number of rows of each named table, in the order of the names."""
    out = None
    for name in sorted(tables):
        one = tables[name].agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)
    return out
