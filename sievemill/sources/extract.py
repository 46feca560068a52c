"""Symbols, references, imports and chunks from source text.

Python goes through the standard library's parser; Go, Rust, TypeScript and JavaScript through declaration patterns and brace
matching, which see declarations, calls and imports but not every construct a grammar would.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "id string, name string, qualified_name string, kind string, file string, language string, start_line int, end_line int, start_byte long, end_byte long, visibility string, parent string"
PARSED = (
    "file string, language string, content_hash string, parse_error string, "
    "symbols array<struct<id:string,name:string,qualified_name:string,kind:string,start_line:int,end_line:int,start_byte:bigint,end_byte:bigint,visibility:string,parent:string>>, "
    "refs array<struct<name:string,line:int,parent_symbol:string,kind:string>>, "
    "imports array<struct<import_path:string,alias:string,line:int,is_relative:boolean>>"
)


def symbol_id(file: str, language: str, qualified: str, kind: str, parent: str | None) -> str:
    return hashlib.sha256("\0".join([file, language, qualified, kind, parent or ""]).encode()).hexdigest()


class _Lines:
    """Line and byte places of character offsets."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def byte(self, at: int) -> int:
        return len(self.text[:at].encode())


def _python(file: str, text: str):
    tree, lines = ast.parse(text), text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line.encode()) + 1)
    symbols, refs, imports = [], [], []

    def name_of(f):
        return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None

    def visit(node, path, owner, in_class):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if in_class else "function"
                qualified = ".".join([*path, child.name])
                sid = symbol_id(file, "python", qualified, kind, path[-1] if path else None)
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                symbols.append((sid, child.name, qualified, kind, child.lineno, child.end_lineno, starts[first - 1], starts[child.end_lineno] - 1, "private" if child.name.startswith("_") else "public", path[-1] if path else None))
                for extra in [*child.decorator_list, *(child.bases if is_class else [])]:
                    visit(ast.Expression(extra), path, owner, in_class)
                # calls belong to the innermost function, never to a class
                visit(child, [*path, child.name], owner if is_class else sid, is_class)
                continue
            if isinstance(child, ast.Call) and (name := name_of(child.func)):
                refs.append((name, child.lineno, owner, "call"))
                if any(v in name.lower() for v in WIRING):
                    for arg in child.args:
                        if isinstance(arg, (ast.Name, ast.Attribute)) and (n := name_of(arg)):
                            refs.append((n, arg.lineno, owner, "call"))
            elif isinstance(child, ast.Import):
                imports.extend((a.name, a.asname, child.lineno, False) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                base = "." * child.level + (child.module or "")
                imports.extend((f"{base}.{a.name}" if child.module else base + a.name, a.asname, child.lineno, child.level > 0) for a in child.names)
            visit(child, path, owner, in_class)

    visit(tree, [], None, False)
    return symbols, refs, imports


# Parts of callee names that wire one thing to another; names among their positional arguments count as called.
WIRING = ("command", "register", "invoke", "include", "router", "add", "mount", "handler", "dispatch", "bind", "plug", "use")

_JS = r"(?P<export>export\s+)?(?:default\s+)?"
PATTERNS = {
    "go": [("method", r"^func\s+\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*(?P<name>\w+)\s*[(\[]"), ("function", r"^func\s+(?P<name>\w+)\s*[(\[]"), ("struct", r"^type\s+(?P<name>\w+)\s+struct\b"), ("interface", r"^type\s+(?P<name>\w+)\s+interface\b"), ("type", r"^type\s+(?P<name>\w+)\s+(?!struct\b|interface\b)\w")],
    "rust": [("impl", r"^[ \t]*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)"), ("function", r"^[ \t]*(?P<export>pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(?P<name>\w+)"), ("struct", r"^[ \t]*(?P<export>pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"), ("enum", r"^[ \t]*(?P<export>pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"), ("trait", r"^[ \t]*(?P<export>pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)")],
    "typescript": [("class", rf"^[ \t]*{_JS}(?:abstract\s+)?class\s+(?P<name>\w+)"), ("interface", rf"^[ \t]*{_JS}interface\s+(?P<name>\w+)"), ("type", rf"^[ \t]*{_JS}type\s+(?P<name>\w+)\s*[=<]"), ("enum", rf"^[ \t]*{_JS}(?:const\s+)?enum\s+(?P<name>\w+)"), ("function", rf"^[ \t]*{_JS}(?:async\s+)?function\*?\s*(?P<name>\w+)\s*[(<]"), ("function", rf"^[ \t]*{_JS}(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"), ("method", r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|new\b)\w+)\s*(?:<[^>]*>)?\([^;{}]*\)\s*(?::\s*[^{;]+)?\{")],
}
PATTERNS["javascript"] = [p for p in PATTERNS["typescript"] if p[0] not in ("interface", "type", "enum")]
IMPORTS = {
    "go": r'^\s*(?:import\s+)?(?P<alias>\w+\s+)?"(?P<path>[^"]+)"\s*$',
    "rust": r"^\s*(?:pub\s+)?use\s+(?P<path>[\w:{}*, ]+?)(?:\s+as\s+(?P<alias>\w+))?;",
    "typescript": r"^\s*(?:import\s+(?:(?P<alias>[\w*{}, $]+)\s+from\s+)?|(?:const|let|var)\s+[\w{}, ]+\s*=\s*require\()['\"](?P<path>[^'\"]+)['\"]",
}
IMPORTS["javascript"] = IMPORTS["typescript"]
KEYWORDS = set([
    "if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "new", "match", "loop", "sizeof", "typeof", "await", "super",
    "import", "require", "defer", "go", "select", "impl", "struct", "enum",
])
_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|`[^`]*`", re.S)


def _blank(text: str) -> str:
    """The text with comments and strings blanked, places kept."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _body_end(clean: str, at: int) -> int:
    """The end of the braces that open behind ``at``; the end of the line where none do."""
    line_end = clean.find("\n", at)
    line_end = len(clean) if line_end < 0 else line_end
    opened = clean.find("{", at)
    stop = clean.find(";", at)
    if opened < 0 or (0 <= stop < opened) or clean.count("\n", at, opened) > 8:
        return line_end
    depth = 0
    for m in re.finditer(r"[{}]", clean[opened:]):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return opened + m.end()
    return len(clean)


def _braces(file: str, language: str, text: str):
    clean, at = _blank(text), _Lines(text)
    found, taken = [], set()
    for kind, pattern in PATTERNS[language]:
        for m in re.finditer(pattern, clean, re.M):
            if m.start("name") not in taken:
                taken.add(m.start("name"))
                d = m.groupdict()
                start = m.start() + len(m.group()) - len(m.group().lstrip())
                found.append([kind, m.group("name"), start, _body_end(clean, m.start("name")), d.get("owner"), bool(d.get("export"))])
    found.sort(key=lambda f: (f[2], -f[3]))
    symbols, owners, stack = [], [], []
    for kind, name, start, end, owner, exported in found:
        while stack and stack[-1][1] <= start:
            stack.pop()
        parents = [s[0] for s in stack]
        if kind == "method" and language != "go" and not any(s[3] in ("class", "impl") for s in stack):
            continue
        if kind == "function" and language == "rust" and stack and stack[-1][3] in ("impl", "trait"):
            kind = "method"
        path = [owner] if owner else parents
        sep = "::" if language == "rust" else "."
        qualified = sep.join([*path, name])
        sid = symbol_id(file, language, qualified, kind, path[-1] if path else None)
        public = name[:1].isupper() if language == "go" else exported
        vis = "public" if public else "unknown" if language in ("typescript", "javascript") else "private"
        stack.append((name, end, sid, kind))
        if kind != "impl":
            symbols.append((sid, name, qualified, kind, at.line(start), at.line(max(start, end - 1)), at.byte(start), at.byte(end), vis, path[-1] if path else None))
            if kind in ("function", "method"):
                owners.append((start, end, sid))
    names_at = {f[2] for f in found}
    refs = []
    for m in re.finditer(r"(?<![\w$])([A-Za-z_]\w*)\s*(?:::<[^>]*>)?\(", clean):
        head = clean[clean.rfind("\n", 0, m.start()) + 1 : m.start()]
        if m.group(1) in KEYWORDS or re.search(r"(?:func(?:\s*\([^)]*\))?|fn|function\*?|class)\s*$", head) or m.start() in names_at:
            continue
        inside = [o for o in owners if o[0] <= m.start() < o[1]]
        refs.append((m.group(1), at.line(m.start()), max(inside)[2] if inside else None, "call"))
    imports = []
    for m in re.finditer(IMPORTS[language], text, re.M):
        path = m.group("path").strip()
        if language == "go" and not re.search(r"import\b", text[: m.end()]):
            continue
        imports.append((path, (m.group("alias") or "").strip() or None, at.line(m.start("path")), path.startswith((".", "crate", "self", "super"))))
    return symbols, refs, imports


def parse_source(file: str, language: str, text: str) -> dict:
    digest = hashlib.sha256(text.encode()).hexdigest()
    row = {"file": file, "language": language, "content_hash": digest, "parse_error": None, "symbols": [], "refs": [], "imports": []}
    try:
        got = _python(file, text) if language == "python" else _braces(file, language, text)
        row["symbols"], row["refs"], row["imports"] = (list(dict.fromkeys(g)) for g in got)
    except (SyntaxError, ValueError, RecursionError) as e:
        row["parse_error"] = f"{type(e).__name__}: {e}"
    return row


def parse_files(files: DataFrame) -> DataFrame:
    """``files(path, language, content)`` to one parsed row each (see ``PARSED``); a file is one bounded unit of work."""

    def run(batches):
        for pdf in batches:
            rows = [parse_source(p, lang, c or "") for p, lang, c in zip(pdf["path"], pdf["language"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["file", "language", "content_hash", "parse_error", "symbols", "refs", "imports"])

    known = files.filter(F.col("language").isin(*PATTERNS, "python"))
    return known.select("path", "language", "content").mapInPandas(run, PARSED)


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The symbol, reference and import tables of parsed rows."""
    return {
        "symbols": parsed.select("file", "language", F.inline("symbols")),
        "refs": parsed.select("file", F.inline("refs")),
        "imports": parsed.select("file", F.inline("imports")),
        "files": parsed.select(F.col("file").alias("path"), "language", "content_hash", "parse_error"),
    }


def chunks(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """A chunk for each symbol: the bytes of its text, with a key that depends on place and content."""
    text = files.select(F.col("path").alias("file"), F.encode("content", "UTF-8").alias("_b"))
    body = F.decode(F.expr("substring(_b, cast(start_byte as int) + 1, cast(end_byte - start_byte as int))"), "UTF-8")
    made = symbols.join(text, "file").select("file", "language", "start_line", "end_line", "start_byte", "end_byte", F.col("id").alias("parent_symbol"), "qualified_name", body.alias("text"))
    h = F.sha2("text", 256)
    key = F.sha2(F.concat_ws("\x00", "file", F.col("start_byte").cast("string"), F.col("end_byte").cast("string"), h), 256)
    return made.withColumn("content_hash", h).withColumn("chunk_id", key)


def keep_last_good(old: DataFrame, new: DataFrame) -> DataFrame:
    """Parsed rows after an update: a file that no longer parses keeps what it had."""
    replaced = new.filter("parse_error is null").select("file")
    first_time = new.join(old.select("file"), "file", "left_anti").filter("parse_error is not null")
    return old.join(replaced, "file", "left_anti").unionByName(new.filter("parse_error is null")).unionByName(first_time)
