"""Log text: line classes, stack parsers, parser dispatch."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed patterns, tried in order within a class; classes do not exclude each other.
LINE_CLASSES = {
    "error": ["error[:;]?\\s*(.+)", "exception[:;]?\\s*(.+)", "failed[:;]?\\s*(.+)", "fatal[:;]?\\s*(.+)", "panic[:;]?\\s*(.+)", "(traceback)", "(stack trace)"],
    "warning": ["warning[:;]?\\s*(.+)", "warn[:;]?\\s*(.+)", "deprecated[:;]?\\s*(.+)", "caution[:;]?\\s*(.+)"],
    "success": ["success[:;]?\\s*(.+)", "completed[:;]?\\s*(.+)", "passed[:;]?\\s*(.+)", "ok[:;]?\\s*(.+)", "✓\\s*(.+)", "✅\\s*(.+)"],
    "build": ["compiling\\s+(.+)", "building\\s+(.+)", "linking\\s+(.+)", "bundling\\s+(.+)", "webpack\\s+(.+)", "rollup\\s+(.+)"],
    "test": ["running\\s+tests?\\s*(.+)", "test\\s+(.+?)\\s+(?:passed|failed|ok|error)", "(\\d+\\s+(?:passed|failed|skipped))", "coverage[:;]?\\s*(.+)"],
}
TIMESTAMPS = ["[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}", "[0-9]{2}:[0-9]{2}:[0-9]{2}"]
ONLY_FOR = {"build": ("build", "runtime"), "test": ("test", "runtime")}


def extracted(line: Column, kind: str) -> Column:
    """What the first matching pattern of a class captures; null where none matches."""
    return F.coalesce(*[F.when(line.rlike(f"(?i){p}"), F.regexp_extract(line, f"(?i){p}", 1)) for p in LINE_CLASSES[kind]])


def classify_lines(logs: DataFrame, log_type: str = "runtime") -> DataFrame:
    """``logs(source, text)`` to a row for each non-blank line: source, line_number, content and one column for each class."""
    rows = logs.select("source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "raw"))
    content = F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))
    out = rows.select("source", (F.col("pos") + 1).alias("line_number"), content.alias("content")).filter("content != ''")
    kinds = [k for k in LINE_CLASSES if log_type in ONLY_FOR.get(k, (log_type,))]
    stamps = F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(p), 0) for p in TIMESTAMPS]))
    return out.select("*", *[(extracted(F.col("content"), k) if k in kinds else F.lit(None).cast("string")).alias(k) for k in LINE_CLASSES], stamps.alias("timestamps"))


def summarise_lines(classified: DataFrame) -> DataFrame:
    """Counters of each source."""
    return classified.groupBy("source").agg(
        F.max("line_number").alias("last_line"),
        *[F.count_if(F.col(k).isNotNull()).alias(f"{k}_count") for k in LINE_CLASSES],
        F.max(F.size("timestamps") > 0).alias("has_timestamps"),
    )


def generic_errors(logs: DataFrame, around: int = 2) -> DataFrame:
    """Lines with a problem word: message, location hints, severity, type, and the lines around them, all from one split."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = logs.select("source", F.posexplode(lines).alias("pos", "line"), lines.alias("lines")).filter(F.col("line").rlike("(?i)error|exception|fail|critical|fatal|panic|warn"))
    first = F.greatest(F.col("pos") - around, F.lit(0))
    where = T.file_and_line("line")
    return rows.select(
        "source",
        T.clean_message("line").alias("message"),
        where["file"].alias("file_hint"),
        where["line"].alias("line_hint"),
        F.lit(None).cast("string").alias("traceback"),
        T.error_type("line").alias("error_type"),
        T.severity("line").alias("severity"),
        F.lit("generic").alias("parser_type"),
        F.create_map(F.lit("line_number"), (F.col("pos") + 1).cast("string"), F.lit("context"), F.array_join(F.slice("lines", first + 1, F.col("pos") - first + 1 + around), "\n")).alias("context"),
    )


# --- stack parsers: rows to rows, one text at a time ------------------------------------------------------------------

ERROR_SCHEMA = "source string, message string, file_hint string, line_hint int, traceback string, error_type string, severity string, parser_type string, context map<string,string>"
PY_START = re.compile(r"^\s*Traceback \(most recent call last\):")
PY_FRAME = re.compile(r'^\s*File "([^"]+)", line (\d+)')
PY_ERROR = re.compile(r"^\s*([A-Za-z_][\w.]*(?:Error|Exception|Warning|Interrupt|Exit)): ?(.*)$")
JAVA_ERROR = re.compile(r"^\s*(?:Exception in thread \"[^\"]*\" |Caused by: )?([a-z][\w$]*(?:\.[\w$]+)+(?:Exception|Error|Throwable))(?:: (.*))?$")
JAVA_FRAME = re.compile(r"^\s*at ([\w$.<>]+)\(([\w$]+\.java):(\d+)\)")
JAVA_COMPILE = re.compile(r"^(.+\.java):(\d+): (error|warning): (.+)$")
JS_ERROR = re.compile(r"^\s*(?:Uncaught )?(?:\(in promise\) )?([A-Z]\w*Error): (.*)$")
JS_FRAME = re.compile(r"^\s*at (?:.*? \()?((?:[A-Za-z]:)?[^\s():]+\.(?:[cm]?[jt]sx?)):(\d+)(?::\d+)?\)?")
JS_BUILD = re.compile(r"^(?:ERROR in|Module not found:|Failed to compile)\s*(.*)$")
#: Frames of libraries, fixed values: the first frame outside them is the hint.
JAVA_LIBRARIES = ("java.", "javax.", "sun.", "jdk.", "org.springframework.", "org.apache.", "com.sun.", "kotlin.")
JS_LIBRARIES = ("node_modules", "internal/", "webpack", "node:")
BY_SUFFIX = {"py": "python", "java": "java", "kt": "java", "js": "javascript", "ts": "javascript", "jsx": "javascript", "tsx": "javascript"}


def _row(source, message, file, line, lines, kind, severity, parser, **context):
    return (source, message.strip(), file, line, "\n".join(lines) or None, kind, severity, parser, {k: str(v) for k, v in context.items() if v})


def _frames(lines: list[str], at: int, frame: re.Pattern, also=lambda s: False) -> int:
    end = at
    while end < len(lines) and (frame.match(lines[end]) or also(lines[end])):
        end += 1
    return end


def parse_python(source: str, text: str) -> Iterator[tuple]:
    """Tracebacks once each, hinted at their last frame; then exception lines that stand alone."""
    lines, i = text.split("\n"), 0
    while i < len(lines):
        if PY_START.match(lines[i]):
            end = i + 1
            while end < len(lines) and not PY_ERROR.match(lines[end]) and (lines[end].startswith((" ", "\t")) or not lines[end].strip()):
                end += 1
            frames = [m for s in lines[i:end] if (m := PY_FRAME.match(s))]
            error = PY_ERROR.match(lines[end]) if end < len(lines) else None
            hint = frames[-1] if frames else None
            yield _row(source, error.group(2) or error.group(1) if error else "Traceback", hint and hint.group(1), hint and int(hint.group(2)), lines[i : end + 1], error.group(1) if error else "Traceback", "error", "python")
            i = end + 1
        elif error := PY_ERROR.match(lines[i]):
            near = [m for s in lines[max(0, i - 3) : i + 4] if (m := PY_FRAME.match(s))]
            yield _row(source, error.group(2) or error.group(1), near[0].group(1) if near else None, int(near[0].group(2)) if near else None, [], error.group(1), "error", "python")
            i += 1
        else:
            i += 1


def _stacks(source, text, error, frame, outside, parser) -> Iterator[tuple]:
    lines, i = text.split("\n"), 0
    while i < len(lines):
        if m := error.match(lines[i]):
            end = _frames(lines, i + 1, frame, lambda s: s.strip().startswith("... "))
            frames = [f for s in lines[i + 1 : end] if (f := frame.match(s))]
            own = next((f for f in frames if outside(f)), frames[0] if frames else None)
            place = (own.group(own.lastindex - 1), int(own.group(own.lastindex))) if own else (None, None)
            yield _row(source, m.group(2) or m.group(1), *place, lines[i:end] if frames else [], m.group(1).rpartition(".")[2], "error", parser, caused_by="Caused by" in lines[i])
            i = end
        else:
            yield from _others(source, lines[i], parser)
            i += 1


def _others(source, line, parser):
    if parser == "java" and (m := JAVA_COMPILE.match(line)):
        yield _row(source, m.group(4), m.group(1), int(m.group(2)), [], "CompileError", m.group(3), "java")
    elif parser == "java" and re.search(r"BUILD FAILURE|FAILURE: Build failed|APPLICATION FAILED TO START", line):
        yield _row(source, line, None, None, [], "SpringError" if "APPLICATION" in line else "BuildError", "critical", "java")
    elif parser == "javascript" and (m := JS_BUILD.match(line)):
        yield _row(source, m.group(1) or line, None, None, [], "BuildError", "error", "javascript")
    elif parser == "javascript" and re.match(r"\s*Warning: (Each child|React|Cannot update|Can't perform)", line):
        yield _row(source, line, None, None, [], "ReactWarning", "warning", "javascript")


def parse_java(source: str, text: str) -> Iterator[tuple]:
    return _stacks(source, text, JAVA_ERROR, JAVA_FRAME, lambda f: not f.group(1).startswith(JAVA_LIBRARIES), "java")


def parse_javascript(source: str, text: str) -> Iterator[tuple]:
    return _stacks(source, text, JS_ERROR, JS_FRAME, lambda f: not any(x in f.group(1) for x in JS_LIBRARIES), "javascript")


def parse_generic(source: str, text: str) -> Iterator[tuple]:
    for n, line in enumerate(text.split("\n"), 1):
        if re.search(r"(?i)error|exception|fail|critical|fatal|panic|warn", line):
            place = re.search(r"([\w$./\\-]+\.[A-Za-z]{1,5}):(\d+)", line)
            kind = re.search(r"\w*(?:error|exception|failure)", line, re.I)
            level = "critical" if re.search(r"(?i)critical|fatal|panic", line) else "error" if re.search(r"(?i)error|exception|fail", line) else "warning"
            yield _row(source, re.sub(r"\s+", " ", re.sub(r"\x1b\[[0-9;]*[A-Za-z]", "", line)), place and place.group(1), place and int(place.group(2)), [], kind.group() if kind else "Unknown", level, "generic", line_number=n)


#: The registry; ``register_parser`` adds to it.
PARSERS = {"python": parse_python, "java": parse_java, "javascript": parse_javascript, "generic": parse_generic}


def register_parser(name: str, parser) -> None:
    """``parser(source, text)`` yields rows of ``ERROR_SCHEMA``; it is used where ``parser_kind`` names it."""
    PARSERS[name] = parser


def parser_kind(source: Column | str, text: Column | str) -> Column:
    """All suffixes are looked at before any content."""
    s, t = (F.col(c) if isinstance(c, str) else c for c in (source, text))
    suffix = F.lower(F.regexp_extract(s, r"\.([A-Za-z]+)(?:\.log)?$", 1))
    table = F.create_map(*[F.lit(x) for kv in BY_SUFFIX.items() for x in kv])
    content = (
        F.when(t.rlike(r"Traceback \(most recent call last\)|(?m)^\s*File \"[^\"]+\", line [0-9]+"), "python")
        .when(t.rlike(r"(?m)^\s*at [A-Za-z0-9_$.<>]+\([A-Za-z0-9_$]+\.java:[0-9]+\)|Caused by: |\.java:[0-9]+: error"), "java")
        .when(t.rlike(r"(?m)^\s*at .*\.[cm]?[jt]sx?:[0-9]+|(Type|Reference|Syntax|Range)Error: |Module not found"), "javascript")
        .otherwise("generic")
    )
    return F.coalesce(table[suffix], content)


def parse_errors(logs: DataFrame) -> DataFrame:
    """``logs(source, text)`` to error rows by the parser each text calls for; null texts give none."""
    named = logs.filter("text is not null").select("source", "text", parser_kind("source", "text").alias("kind"))
    parsers = dict(PARSERS)

    def run(batches):
        names = [f.split()[0] for f in ERROR_SCHEMA.split(", ")]
        for pdf in batches:
            rows = [r for s, t, k in zip(pdf["source"], pdf["text"], pdf["kind"], strict=True) for r in parsers[k](s, t)]
            out = pd.DataFrame(rows, columns=names)
            out["line_hint"] = out["line_hint"].astype("Int32")
            yield out

    return named.mapInPandas(run, ERROR_SCHEMA)
