"""Classification of paths and queries as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, suffixes and word lists that results must agree on.
BUILD_NAMES = [
    "go.mod", "go.sum", "cargo.toml", "cargo.lock", "package.json", "package-lock.json", "dockerfile", "makefile", "procfile", "justfile",
    "brewfile", "gemfile", "rakefile",
]
TEST_DIRS = ["/tests/", "/test/", "/__tests__/"]
TEST_ENDS = [".test.ts", ".test.js", ".test.tsx", ".test.jsx", ".spec.ts", ".spec.js", ".spec.tsx", ".spec.jsx"]
GENERATED_ROOTS = ["dist", "build", "target", "node_modules"]
GENERATED_INNER = ["/.next/", "/.nuxt/"]
SOURCE_EXT = ["py", "ts", "tsx", "js", "jsx", "go", "rs", "java", "kt", "c", "cc", "cpp", "h", "hpp", "cs", "rb", "php", "swift", "sql", "sh", "ps1"]
CONFIG_EXT = ["json", "yaml", "yml", "toml", "ini", "env", "xml", "proto"]
DOC_EXT = ["md", "markdown", "rst", "txt", "adoc"]
SEARCHABLE_EXT = SOURCE_EXT + ["json", "yaml", "yml", "toml", "ini", "xml", "proto", "md", "txt", "rst"]
EXCLUDED_DIRS = [".git", ".context", ".opencode/index", "node_modules", "dist", "build", "target", "__pycache__", ".pytest_cache", ".next", ".nuxt", "coverage"]
LANGUAGES = {"rs": "rust", "py": "python", "go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript"}
QUERY_STOP = ["where", "what", "who", "how", "find", "where's", "when", "why", "which"]
IDENT_STOP = QUERY_STOP + ["the", "is", "are", "for", "and", "or", "to", "in", "of", "a", "an"]
EXTRACT_STOP = [
    "where", "what", "who", "how", "which", "when", "why", "the", "is", "are", "for", "and", "or", "to", "in", "of", "a", "an", "find", "show",
    "please", "example", "file", "trace", "flow", "generation", "calls", "callers", "callees", "tests", "test", "cover", "covers", "implemented",
    "implementation",
]
TARGET_STOP = [
    "where", "what", "who", "how", "the", "is", "are", "for", "and", "or", "to", "in", "of", "a", "an", "calls", "callers", "callees", "tests",
    "test", "cover", "covers", "implemented", "implementation", "generation", "flow", "trace", "secret", "redaction",
]
CONTEXT_STOP = ["find", "where", "what", "how", "the", "for", "in", "of", "is", "are", "a", "an", "example", "file", "please", "show", "me"]
RE_TEST = r"(^|[^a-z0-9_])(tests? for|where is .* tested|what tests cover|test coverage|specs? for)($|[^a-z0-9_])"
RE_DEPENDENCY = r"(^|[^a-z0-9_])(who calls|what calls|callers|callees|depends on|what breaks if|impact of|used by|transitive|calls?)($|[^a-z0-9_])"
RE_DEFINITION = r"(^|[^a-z0-9_])(where is|where's|defined|definition|implementation|implemented|define)($|[^a-z0-9_])"
RE_CONCEPT = r"enforced|responsible|logic|handle|prevent|validate|implemented|ontology|pipeline|wired"
RE_SPECIAL_FILE = r"^(Dockerfile|Makefile|Procfile|Justfile|Brewfile|Gemfile|Rakefile|go\.mod|go\.sum)$"
RE_KEYWORD_ID = r"(?i)(^|[^a-z0-9_])(function|class|method|symbol|struct|interface|type|func)\s+[A-Za-z_][A-Za-z0-9_:]*"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """The part behind the last dot of the name, lower-case; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def _alternatives(items: list[str]) -> str:
    return "|".join(re.escape(i) for i in items)


def classify_path(path: Column | str) -> Column:
    """source, test, doc, config, build, generated or unknown.

    Test folders count only below another folder; generated ones also at the root; tests come before generated files.
    """
    p = F.lower(_col(path))
    name, ext = F.lower(basename(path)), extension(path)
    return (
        F.when(name.isin(BUILD_NAMES) | name.startswith("dockerfile."), "build")
        .when(p.rlike(_alternatives(TEST_DIRS)) | name.rlike(r"_test\.|^test_") | name.rlike(f"({_alternatives(TEST_ENDS)})$"), "test")
        .when(p.rlike(f"(^|/)({_alternatives(GENERATED_ROOTS)})/|^({_alternatives(GENERATED_ROOTS)})$|{_alternatives(GENERATED_INNER)}"), "generated")
        .when(ext.isin(SOURCE_EXT), "source")
        .when(ext.isin(CONFIG_EXT), "config")
        .when(ext.isin(DOC_EXT), "doc")
        .otherwise("unknown")
    )


def is_excluded(path: Column | str) -> Column:
    """Engine-internal folders, at the root or below it, in any case."""
    names = _alternatives(EXCLUDED_DIRS)
    return F.lower(_col(path)).rlike(f"^({names})$|(^|/)({names})/")


def is_searchable(path: Column | str, kind: Column | None = None) -> Column:
    kind = classify_path(path) if kind is None else kind
    return kind.isin("source", "test", "doc", "config", "build") | ((kind == "unknown") & extension(path).isin(SEARCHABLE_EXT))


def detect_language(path: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(table[extension(path)], F.lit("unknown"))


# Extensions of the project summary, of the compressor and of the architecture scan.
SUMMARY_LANGUAGES = {
    "py": "Python", "js": "JavaScript", "ts": "TypeScript", "jsx": "React/JavaScript", "tsx": "React/TypeScript", "md": "Markdown",
    "json": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "html": "HTML", "css": "CSS", "scss": "SCSS", "less": "Less",
    "sql": "SQL", "sh": "Shell", "bat": "Batch", "dockerfile": "Docker",
}
COMPRESS_LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "java": "java", "c": "c",
    "cpp": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "swift": "swift",
    "kt": "kotlin", "scala": "scala", "m": "objective-c", "sh": "bash", "sql": "sql", "html": "html", "css": "css", "scss": "scss",
    "sass": "sass", "less": "less", "vue": "vue", "svelte": "svelte", "xml": "xml", "json": "json", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "ini": "ini", "cfg": "ini", "csv": "csv", "md": "markdown", "txt": "text", "gitignore": "gitignore",
}
ARCHITECTURE_LANGUAGES = {
    "py": "Python", "pyw": "Python", "js": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "java": "Java",
    "kt": "Kotlin", "kts": "Kotlin", "go": "Go", "rs": "Rust", "cs": "C#", "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++",
    "hh": "C++", "hxx": "C++", "c": "C", "h": "C", "swift": "Swift", "rb": "Ruby", "php": "PHP", "scala": "Scala", "sh": "Shell",
    "bash": "Shell", "sql": "SQL", "html": "HTML", "htm": "HTML", "css": "CSS", "scss": "CSS", "sass": "CSS",
}


def language_by(path: Column | str, table: dict[str, str], other: str | None = "Unknown") -> Column:
    """A language by one of the extension maps; names that only have a leading dot (``.gitignore``) go by what follows it where the map has it."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    bare = F.lower(F.regexp_extract(basename(path), r"^\.([^.]+)$", 1))
    dotted = F.when(bare == "gitignore", known[bare])
    return F.coalesce(known[extension(path)], dotted, F.lit(other))


def normalise_path(path: Column | str) -> Column:
    """Forward slashes, no leading ``./``; null for empty, absolute and escaping paths."""
    p = F.regexp_replace(F.replace(_col(path), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    return F.when((p != "") & ~p.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)"), p)


#: Summary buckets, fixed values: substring ladders in order.
SUMMARY_BUCKETS = [("tests", ["test", "spec"]), ("docs", ["readme", "doc", ".md", "changelog", "license"]), ("config", ["config", ".json", ".yaml", ".yml", ".toml", ".ini", ".env"]), ("scripts", ["script", ".sh", ".ps1", ".bat"]), ("build", ["dockerfile", "makefile", "build", ".gradle", "pom.xml"]), ("frontend", [".tsx", ".jsx", ".vue", ".css", ".html", "frontend", "ui/"]), ("backend", [".py", ".go", ".rs", ".java", "backend", "api/"])]


def summary_bucket(path: Column | str) -> Column:
    p, out = F.lower(_col(path)), None
    for name, marks in SUMMARY_BUCKETS:
        hit = p.rlike(_alternatives(marks))
        out = (F if out is None else out).when(hit, name)
    return out.otherwise("other")


#: Files the compressor leaves alone, fixed patterns.
SKIP_FILES = r"(?i)\.(png|jpe?g|gif|svg|ico|webp|pdf|zip|tar|gz|7z|exe|dll|so|dylib|class|jar|pyc|lock|min\.js|min\.css|map)$|(^|/)(node_modules|\.git|dist|build|__pycache__|\.venv|venv)/"


def is_skipped(path: Column | str) -> Column:
    return _col(path).rlike(SKIP_FILES)


def visibility(language: Column, name: Column, declaration: Column) -> Column:
    """public or private by each language's rule: ``pub``, leading underscore, capital letter, ``export``."""
    return (
        F.when(language == "rust", F.when(declaration.rlike(r"^\s*pub([\s(]|$)"), "public").otherwise("private"))
        .when(language == "python", F.when(name.startswith("_"), "private").otherwise("public"))
        .when(language == "go", F.when(name.rlike("^[A-Z]"), "public").otherwise("private"))
        .when(language.isin("typescript", "javascript"), F.when(declaration.rlike(r"^\s*export\s"), "public").otherwise("unknown"))
        .otherwise("unknown")
    )


# --- queries ---------------------------------------------------------------------------------------------------------


def _ident_shape(t: Column) -> Column:
    """An identifier token: plain name that is snake, camel, Pascal (also a single capitalised word) or SCREAMING."""
    shape = (
        t.rlike(r"^_*[a-z]+_[a-z_0-9]*$|^[a-z]+_[a-z_0-9]*$|^[A-Z]+_[A-Z_0-9]*$")
        | t.rlike(r"^[a-z]+[A-Z][a-zA-Z0-9]*$|^[A-Z][a-z]+[A-Z][a-zA-Z0-9]*$|^[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+$")
        | (t.rlike(r"^[A-Z][a-z][a-zA-Z0-9]*$") & (F.length(t) >= 3) & ~F.lower(t).isin(QUERY_STOP))
    )
    return t.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$") & shape


def _qualified(t: Column) -> Column:
    return t.rlike(r"[a-zA-Z_][A-Za-z0-9_]*[.:]{1,2}[a-zA-Z_][A-Za-z0-9_]*") | (F.instr(t, "::") > 0)


def _last_part(t: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(t, "[.:]"), -1), "^[\"'`?!,;:]+|[\"'`?!,;:]+$", "")


def _looks_like_file(t: Column) -> Column:
    clean = F.regexp_replace(t, r"^[\"'?.!,;:()]+|[\"'?.!,;:()]+$", "")
    ext = extension(clean)
    known = classify_path(clean).isin("source", "config", "build", "doc")
    loose = (F.length(clean) < 40) & F.lower(clean).rlike(r"\.[a-z0-9]{1,5}$")
    return (clean != "") & (clean.rlike(RE_SPECIAL_FILE) | ((ext != "") & (known | loose)))


def classify_query(query: Column | str) -> Column:
    """TEST, DEPENDENCY, EXACT, MIXED, CONCEPTUAL or SYMBOL: the first rule that holds, in this order."""
    q = F.trim(F.regexp_replace(F.coalesce(_col(query), F.lit("")), r"\s+", " "))
    low = F.lower(q)
    words = F.filter(F.split(q, " "), lambda w: w != "")
    n = F.size(words)
    quoted = q.rlike(r"^\".*\"$|^'.*'$") & (F.length(q) >= 2)
    has_file = F.exists(words, _looks_like_file)
    path_like = q.rlike(r"[/\\].+\.[A-Za-z0-9_]+|(^|[^A-Za-z0-9_])[A-Za-z0-9_]+/[A-Za-z0-9_]+")
    after = F.element_at(F.split(F.trim(F.regexp_replace(q, "(?i)^how (is|are)", "")), " "), 1)
    concrete = _ident_shape(_last_part(after))
    how_is = (n >= 4) & low.rlike("^how (is|are)") & low.rlike(RE_CONCEPT) & ~concrete
    whole_id = q.rlike(r"^[A-Za-z_][A-Za-z0-9_:]*(\.[A-Za-z_][A-Za-z0-9_]*)*$") & (F.length(q) > 2)
    ident = lambda w: _ident_shape(_last_part(w)) | _qualified(w)
    any_id = F.exists(words, ident)
    free = F.filter(F.regexp_extract_all(q, F.lit("[A-Za-z_][A-Za-z0-9_:]*"), 0), lambda w: ~F.lower(F.element_at(F.split(w, "[.:]"), -1)).isin(IDENT_STOP))
    has_id = F.exists(free, lambda w: _ident_shape(F.element_at(F.split(w, "[.:]"), -1)) | _qualified(w))
    definition = low.rlike(RE_DEFINITION)
    symbolic = (whole_id | q.rlike(RE_KEYWORD_ID) | (definition & has_id)) & any_id
    question = low.rlike("^(where|what|how)") | (F.instr(q, "?") > 0)
    single_id = (n == 1) & q.rlike("^[A-Za-z_][A-Za-z0-9_:]*$") & has_id
    return (
        F.when(low.rlike(RE_TEST), "TEST")
        .when(low.rlike(RE_DEPENDENCY), "DEPENDENCY")
        .when(quoted, "EXACT")
        .when((n == 1) & has_file, "EXACT")
        .when(path_like | has_file, F.when(n <= 3, "EXACT").otherwise("MIXED"))
        .when(how_is, "CONCEPTUAL")
        .when(symbolic, F.when(n <= 6, "SYMBOL").otherwise("MIXED"))
        .when(definition & any_id, "SYMBOL")
        .when((n >= 4) & (question | low.rlike(RE_CONCEPT)), "CONCEPTUAL")
        .when(single_id, "SYMBOL")
        .when((n > 6) & has_id, "MIXED")
        .when(n >= 6, "CONCEPTUAL")
        .when(n >= 1, "MIXED")
        .otherwise("CONCEPTUAL")
    )


def _dedup_ci(items: Column, better) -> Column:
    """One spelling of each case-insensitive word, in order of first sight: a later one wins where ``better(new, old)``."""
    start = F.array().cast("array<string>")

    def step(acc: Column, t: Column) -> Column:
        at = F.array_position(F.transform(acc, F.lower), F.lower(t)).cast("int")
        old = F.get(acc, at - 1)
        swapped = F.transform(acc, lambda x, i: F.when((i == at - 1) & better(t, old), t).otherwise(x))
        return F.when(at == 0, F.concat(acc, F.array(t))).otherwise(swapped)

    return F.aggregate(items, start, step)


def _by_rank(items: Column, *ranks) -> Column:
    """Sorted by the given integer ranks, then the word itself, so the order never depends on a hash map."""
    ranked = F.transform(items, lambda t: F.struct(*[r(t).alias(f"r{i}") for i, r in enumerate(ranks)], t.alias("word")))
    return F.transform(F.array_sort(ranked), lambda s: s["word"])


def _no(rule: Column) -> Column:
    return F.when(rule, 0).otherwise(1)


def extract_identifiers(query: Column | str, limit: int = 5) -> Column:
    """Identifiers of a query: snake first, then Pascal, then the longest, ``limit`` at most."""
    found = F.regexp_extract_all(F.coalesce(_col(query), F.lit("")), F.lit(r"[A-Za-z_][A-Za-z0-9_]*(?:[.:]{1,2}[A-Za-z_][A-Za-z0-9_]*)*"), 0)

    def with_parts(t: Column) -> Column:
        parts = F.filter(F.split(t, "[.:]"), lambda p: F.length(p) >= 3)
        return F.when((F.instr(t, ".") > 0) | (F.instr(t, "::") > 0), F.concat(F.array(t), parts)).otherwise(F.array(t))

    def wanted(t: Column) -> Column:
        upper = t.rlike("^[A-Z]$")
        shape = (F.instr(t, "_") > 0) | (F.instr(t, ".") > 0) | (F.instr(t, "::") > 0) | t.rlike("^[a-z]+[A-Z]|^[A-Z][a-z0-9]*[A-Z][a-zA-Z0-9]*$|^[A-Z][a-z][a-zA-Z0-9]*$") | F.lower(t).rlike("^[a-z]{3,}$")
        return ~F.lower(t).isin(EXTRACT_STOP) & (upper | ((F.length(t) >= 3) & shape))

    better = lambda new, old: ((F.instr(new, "_") > 0) & (F.instr(old, "_") == 0)) | ((new == F.lower(new)) & (old != F.lower(old)))
    uniq = _dedup_ci(F.filter(F.flatten(F.transform(found, with_parts)), wanted), better)
    return F.slice(_by_rank(uniq, lambda t: _no(F.instr(t, "_") > 0), lambda t: _no(t.rlike("^[A-Z]")), lambda t: -F.length(t)), 1, limit)


def target_symbol(query: Column | str) -> Column:
    """The symbol a query is about, lower-case; null where no word is long enough."""
    found = F.regexp_extract_all(F.coalesce(_col(query), F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0)
    kept = F.filter(found, lambda t: ~F.lower(t).isin(TARGET_STOP) & (F.length(t) >= 3))
    uniq = _dedup_ci(kept, lambda new, old: (F.instr(new, "_") > 0) & (F.instr(old, "_") == 0))
    return F.lower(F.get(_by_rank(uniq, lambda t: _no(F.instr(t, "_") > 0), lambda t: _no(t.rlike("^[A-Z][a-z]+[A-Z]")), lambda t: -F.length(t)), 0))


def file_tokens(query: Column | str) -> Column:
    """Names and paths with an extension, in order of first sight."""
    found = F.regexp_extract_all(F.coalesce(_col(query), F.lit("")), F.lit(r"[A-Za-z0-9_./-]+\.[A-Za-z0-9_]{1,8}(?![A-Za-z0-9_])"), 0)
    return F.array_distinct(F.filter(found, lambda t: t.rlike("[A-Za-z]") & (F.length(t) < 100)))


def context_tokens(query: Column | str) -> Column:
    """Up to two words that may name a folder: not stop words, not files, dashed or short."""
    words = F.transform(F.split(F.coalesce(_col(query), F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, r"^[\"'?!,;:().]+|[\"'?!,;:().]+$", ""))
    files = F.transform(file_tokens(query), F.lower)
    kept = F.filter(
        words,
        lambda w: (F.length(w) >= 3)
        & ~F.lower(w).isin(CONTEXT_STOP)
        & ~F.array_contains(files, F.lower(w))
        & w.rlike("^[^/]*$")
        & (w.rlike("[-_]") | w.rlike("^[A-Za-z0-9-]+$"))
        & ((F.instr(w, "-") > 0) | (F.length(w) <= 10)),
    )
    return F.slice(_dedup_ci(kept, lambda new, old: F.lit(False)), 1, 2)


def is_unambiguous_exact(query: Column | str) -> Column:
    q = F.trim(_col(query))
    return q.rlike(r"^\".+\"$|^'.+'$|/") | (F.size(file_tokens(q)) > 0)
