"""Text functions as Column expressions: everything here stays inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of lexical scoring.
BM25_K1, BM25_B = 1.2, 0.75
MAX_TOKEN_BYTES = 64


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def camel_parts(token: Column) -> Column:
    """``PDFLoader`` to PDF, Loader: cut where lower meets upper, and before the last upper of a run."""
    return F.split(token, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def code_tokens(text: Column | str) -> Column:
    """Tokens of source-like text, each with its lower-case form, snake parts and camel parts; repeats count.

    A token with slashes yields only its parts; one with dots yields itself and its parts.
    Tokens over 64 bytes are left out.
    """
    raw = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"[A-Za-z0-9_]+(?:[./][A-Za-z0-9_]+)*"), 0)

    def with_lower(x: Column) -> Column:
        low = F.lower(x)
        return F.when(low == x, F.array(x)).otherwise(F.array(x, low))

    def split_part(part: Column) -> Column:
        snake = F.when(F.instr(part, "_") > 0, F.filter(F.split(part, "_"), lambda s: s != "")).otherwise(F.array().cast("array<string>"))
        camel = camel_parts(part)
        camel = F.when(F.size(camel) > 1, camel).otherwise(F.array().cast("array<string>"))
        return F.concat(with_lower(part), F.flatten(F.transform(snake, with_lower)), F.flatten(F.transform(camel, with_lower)))

    def expand(token: Column) -> Column:
        parts = F.filter(F.split(token, r"[./]"), lambda s: s != "")
        inner = F.flatten(F.transform(parts, split_part))
        slash, dot = F.instr(token, "/") > 0, F.instr(token, ".") > 0
        plain = ~token.rlike("[._/]|[a-z][A-Z]|[A-Z][A-Z][a-z]")  # most words: nothing to take apart
        return F.when(plain, with_lower(token)).when(slash, inner).when(dot, F.concat(with_lower(token), inner)).otherwise(split_part(token))

    return F.filter(F.flatten(F.transform(raw, expand)), lambda s: (F.octet_length(s) <= MAX_TOKEN_BYTES) & (s != ""))


def snake_case(s: Column | str) -> Column:
    """``fooBar`` to ``foo_bar``: an underscore before each upper letter but the first character; acronyms fall apart."""
    return F.lower(F.regexp_replace(_col(s), "(?<!^)([A-Z])", "_$1"))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25_term(tf: Column, length: Column, average: Column, idf: Column) -> Column:
    mean = F.greatest(average, F.lit(1.0))
    return idf * (tf * (BM25_K1 + 1)) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double; 0 where the dimensions differ."""
    a, b = _col(a), _col(b)
    return F.when(
        F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    ).otherwise(F.lit(0.0))


def l2_normalise(v: Column | str) -> Column:
    v = _col(v)
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))), F.lit(1e-6))
    return F.transform(v, lambda x: x.cast("double") / norm)


def hash_embedding(text: Column | str, dimension: int = 64) -> Column:
    """A deterministic stand-in for a model: bytes of SHA-256, repeated, to [-1, 1] and unit length."""
    digest = F.sha2(F.coalesce(_col(text), F.lit("")), 256)
    byte = lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1.0
    return l2_normalise(F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), byte))


def representation(language: Column, path: Column, qualified: Column, body: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(language, F.lit("")), F.coalesce(path, F.lit("")), F.coalesce(qualified, F.lit("")), F.coalesce(body, F.lit("")))


def token_estimate(text: Column | str) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(_col(text), F.lit(""))) / 4).cast("long")


def entropy(s: Column | str) -> Column:
    """Shannon entropy over characters, in bits."""
    s = _col(s)
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars)
    each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.coalesce(F.aggregate(each, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)), F.lit(0.0))


def high_entropy(token: Column | str) -> Column:
    bare = F.regexp_replace(F.trim(_col(token)), "^[\"']+|[\"']+$", "")
    return (F.length(bare) >= 20) & (entropy(bare) >= 3.5)


# The redaction chain, patterns and replacements of each stage in the order they are applied.
KEYS = [
    (r'="(sk-[A-Za-z0-9_-]{20,})"', '="[REDACTED_KEY]"'),
    (r"='(sk-[A-Za-z0-9_-]{20,})'", "'[REDACTED_KEY]'"),
    (r"^\s*(sk-[A-Za-z0-9_-]{20,})\s*$", "[REDACTED_KEY]"),
    (r':\s*"(sk-[A-Za-z0-9_-]{20,})"', ': "[REDACTED_KEY]"'),
    (r":\s*'(sk-[A-Za-z0-9_-]{20,})'", ": '[REDACTED_KEY]'"),
    (r"=\s*(sk-[A-Za-z0-9_-]{20,})(?=\s|$)", "=[REDACTED_KEY]"),
    (r"(?<![A-Za-z0-9_])(sk-[A-Za-z0-9_-]{20,})(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])", "[REDACTED_KEY]"),
    (r'(?<![A-Za-z0-9_])(API_KEY)\s*=\s*"\[REDACTED_KEY\]"', "$1 = [REDACTED_KEY]"),
    (r"(?<![A-Za-z0-9_])(API_KEY)\s*=\s*'\[REDACTED_KEY\]'", "$1 = [REDACTED_KEY]"),
    (r'=\s*"?\[REDACTED_KEY\]"?\s*$', " = [REDACTED_KEY]"),
    (r"=\s*'?\[REDACTED_KEY\]'?\s*$", " = [REDACTED_KEY]"),
]
CLOUD = [
    (r"(?i)(AWS_ACCESS_KEY_ID|AWS_SECRET_ACCESS_KEY)\s*([=:])\s*[\"']?(AKIA[0-9A-Z]{16}|[A-Za-z0-9+/]{40})[\"']?", "$1 $2 [REDACTED_AWS]"),
    (r"([\"']?)(AKIA[0-9A-Z]{16})([\"']?)", "$1[REDACTED_AWS]$3"),
]
BEARER = [
    (r"(?i)Authorization:\s*Bearer\s+([A-Za-z0-9_.-]{20,})", "Bearer [REDACTED]"),
    (r"(?i)bearer:\s*[\"']?([A-Za-z0-9_.-]{20,})[\"']?", "Bearer [REDACTED]"),
    (r"(?i)Bearer\s+([A-Za-z0-9_.-]{20,})", "Bearer [REDACTED]"),
    (r"(?i)(?<![A-Za-z0-9_])bearer[_\s-]*([A-Za-z0-9_.-]{20,})(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])", "Bearer [REDACTED]"),
    (r"(?i)(?<![A-Za-z0-9_])(bearer[a-z0-9_]{10,})(?![A-Za-z0-9_])", "Bearer [REDACTED]"),
]
PASSWORDS = [
    (r"(?i)(password|passwd|pwd|pass|secret|private_key|privatekey)\s*([=:])\s*[\"']?([^\"'\s]{6,})[\"']?", "$1 $2 [REDACTED]"),
    (r"(?i)(DB_PASSWORD|DATABASE_PASSWORD|USER_PASSWORD|ADMIN_PASSWORD)\s*([=:])\s*[\"']?([^\"'\s]{6,})[\"']?", "$1 $2 [REDACTED]"),
    (r"(?i)(?<![A-Za-z0-9_])[A-Za-z0-9_]*(?:password|passwd|pwd|pass|secret)[A-Za-z0-9_]*\s+[A-Za-z0-9_]{8,}(?![A-Za-z0-9_])", "password = [REDACTED]"),
]
TOKENS = [
    (r"(?i)(jwt|token|auth_token|access_token|refresh_token|session_token)\s*[=:]\s*[\"']?([A-Za-z0-9_.-]{20,})[\"']?", "token=[REDACTED]"),
    (r"(?i)[\"']([a-zA-Z_]*token[a-zA-Z_]*|auth_token|access_token)[\"']:\s*[\"']([A-Za-z0-9_.-]{20,})[\"']", "\"$1\": \"[REDACTED]\""),
    (r"(?i)(?<![A-Za-z0-9_])(?:jwt|token)[_\s-]*([A-Za-z0-9_.-]{20,})(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])", "token=[REDACTED]"),
]
VARIABLES = [(r"\$\{?([A-Z_]*(?:SECRET|TOKEN|PASSWORD|PASSWD|KEY|WEBHOOK|DB|DATABASE)[A-Z_]*)\}?", "[REDACTED]")]
NAMED = [(r"(?i)(JWT_SECRET|SECRET_KEY|API_SECRET|AUTH_SECRET)\s*([=:])\s*[\"']?([^\"'\s]{10,})[\"']?", "$1 $2 [REDACTED]")]
#: Only where the text holds no [REDACTED_KEY].
API_KEY = (r"(?i)(API_KEY)\s*([=:])\s*[\"']?([^\"'\s]{20,})[\"']?", "$1 $2 [REDACTED]")
URLS = [(r"(?i)(DATABASE_URL|MONGODB_URI|REDIS_URL)\s*([=:])\s*[\"']?([^\"'\s]{10,})[\"']?", "$1 $2 [REDACTED]")]
#: Long hex that is not of a digest's length; masked where its entropy is high.
LONG_HEX = r"(?<![A-Za-z0-9_])(?:[a-fA-F0-9]{41,63}|[a-fA-F0-9]{65,})(?![A-Za-z0-9_])"


def replace_all(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def redact_secrets(text: Column | str) -> Column:
    """The ordered chain: keys, cloud keys, bearer, passwords, tokens, variables, named secrets, long high-entropy hex."""
    t = replace_all(F.coalesce(_col(text), F.lit("")), KEYS + CLOUD + BEARER + PASSWORDS + TOKENS + VARIABLES + NAMED)
    # a lambda's argument is made once, however often its body looks at it
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    t = once(t, lambda x: F.when(F.instr(x, "[REDACTED_KEY]") > 0, x).otherwise(F.regexp_replace(x, *API_KEY)))
    long_hex = lambda x: F.filter(F.array_distinct(F.regexp_extract_all(x, F.lit(LONG_HEX), 0)), high_entropy)
    return once(replace_all(t, URLS), lambda x: F.aggregate(long_hex(x), x, lambda acc, y: F.replace(acc, y, F.lit("[REDACTED]"))))


def redact_patterns(text: Column | str, patterns: list[str]) -> Column:
    """Each pattern, multi-line, to ``[REDACTED]``."""
    return replace_all(_col(text), [(f"(?m){p}", "[REDACTED]") for p in patterns])


def compress_whitespace(text: Column | str) -> Column:
    """Lines without trailing blanks; each run of blank lines to one. Linear in the text: each run is matched once, from its start."""
    t = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?<![ \t\r\f\x0B])[ \t\r\f\x0B]++(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\A\n{2,}", "\n"), r"\n{2,}\z", "\n"), r"\n{3,}", "\n\n")


def unique_lines(text: str) -> str:
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


def deduplicate_lines(text: Column | str) -> Column:
    """The first line of each stripped content; runs of blank lines to one, counted after the drop.

    Built-in functions only. Sorted by content and place, a line is the first of its content where its neighbour before differs; back in
    the order of places, a blank line stays where the one that stays before it is not blank. Neighbours meet by ``zip_with``, never by a
    look into an array from inside a lambda, so the work is that of two sorts.
    """
    lines = F.split(F.coalesce(_col(text), F.lit("")), "\n")
    bare = lambda x: F.regexp_replace(x, r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", "")
    placed = F.transform(lines, lambda x, i: F.struct(bare(x).alias("b"), i.alias("i"), x.alias("x")))

    def by_neighbour(rows: Column, stays) -> Column:
        before = F.concat(F.array(F.lit(None)), rows)
        return F.filter(F.zip_with(rows, before, lambda s, p: F.when(stays(s, p), s)), lambda s: s.isNotNull())

    heads = by_neighbour(F.array_sort(F.filter(placed, lambda s: s["b"] != "")), lambda s, p: p.isNull() | (p["b"] != s["b"]))
    kept = F.concat(heads, F.filter(placed, lambda s: s["b"] == ""))
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(s["i"].alias("i"), s["b"].alias("b"), s["x"].alias("x"))))
    some = by_neighbour(ordered, lambda s, p: (s["b"] != "") | p.isNull() | (p["b"] != ""))
    return F.array_join(F.transform(some, lambda s: F.when(s["b"] == "", "").otherwise(s["x"])), "\n")


def sanitise_note(note: Column | str, limit: int = 2000) -> Column:
    clean = F.regexp_replace(_col(note), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit), F.lit("…"))).otherwise(clean)


def clean_message(text: Column | str) -> Column:
    """Without terminal colours, whitespace runs to one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(text), "\\x1B\\[[0-9;]*[A-Za-z]", ""), r"\s+", " "))


#: Where a line names a file and a line number, fixed patterns in order of trust.
LOCATIONS = [
    r"File \"([^\"]+)\", line ([0-9]+)",
    r"\(([A-Za-z0-9_$./\\-]+\.[A-Za-z]+):([0-9]+)(?::[0-9]+)?\)",
    r"at ([A-Za-z0-9_$./\\-]+\.[A-Za-z]+):([0-9]+)",
    r"([A-Za-z0-9_$./\\-]+\.[A-Za-z]{1,5}):([0-9]+)",
    r"in ([A-Za-z0-9_$./\\-]+\.[A-Za-z]{1,5}) on line ([0-9]+)",
]


def file_and_line(text: Column | str) -> Column:
    """struct<file, line> of the first pattern that matches; nulls where none does."""
    t = _col(text)
    pick = lambda i: F.coalesce(*[F.nullif(F.regexp_extract(t, p, i), F.lit("")) for p in LOCATIONS])
    return F.struct(pick(1).alias("file"), pick(2).cast("int").alias("line"))


def severity(text: Column | str) -> Column:
    low = F.lower(_col(text))
    return (
        F.when(low.rlike("critical|fatal|panic"), "critical")
        .when(low.rlike("error|exception|failed|failure"), "error")
        .when(low.rlike("warn|deprecated"), "warning")
        .when(low.rlike("info|debug|notice"), "info")
        .otherwise("error")
    )


def error_type(text: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(_col(text), r"([A-Za-z0-9_]*(?i:error|exception|failure))", 1), F.lit("")), F.lit("Unknown"))


def preview(text: Column | str, query: str) -> Column:
    """The start of a text, cut at a line end between 250 and 350 characters or else at 300, query words in upper-case bold."""
    t = F.coalesce(_col(text), F.lit(""))
    at = F.locate("\n", t, 251)
    cut = F.when(F.length(t) <= 300, t).when(at.between(251, 351), F.substring(t, F.lit(1), at - 1)).otherwise(F.substring(t, 1, 300))
    for word in dict.fromkeys(w for w in query.split() if len(w) > 2):
        safe = "".join(f"\\{c}" if not c.isalnum() else c for c in word)
        cut = F.regexp_replace(cut, f"(?i){safe}", f"**{word.upper()}**")
    return cut


def human_size(n: Column | str) -> Column:
    """Bytes as B, KB, MB, GB or TB with one decimal."""
    n = _col(n).cast("double")
    out = None
    for i, unit in enumerate(["B", "KB", "MB", "GB"]):
        here = F.format_string(f"%.1f {unit}", n / 1024**i)
        out = (F if out is None else out).when(n < 1024 ** (i + 1), here)
    return out.otherwise(F.format_string("%.1f TB", n / 1024**4))


def note_time(filename: Column | str) -> Column:
    """The time in ``handoff_%Y-%m-%d_%H-%M-%S``; null where there is none."""
    stamp = F.regexp_extract(_col(filename), r"handoff_([0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{2}-[0-9]{2}-[0-9]{2})", 1)
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyy-MM-dd_HH-mm-ss"))


def duration_text(start: Column, end: Column) -> Column:
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    return F.when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" minutes"))).otherwise(F.format_string("%.1f hours", seconds / 3600))


def line_slice(text: Column, start: Column, end: Column, limit: int = 400) -> Column:
    """Lines ``start`` to ``end`` (from 1), cut to ``limit`` characters."""
    lines = F.slice(F.split(text, "\n"), F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(1)))
    return F.substring(F.array_join(lines, "\n"), 1, limit)


def content_hash(text: Column | str) -> Column:
    return F.sha2(_col(text), 256)


def key_hash(*parts: Column) -> Column:
    """A position-independent key: SHA-256 over the parts, null parts empty, joined by a zero byte."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def valid_api_key(key: Column | str) -> Column:
    k = _col(key)
    return F.coalesce(F.when(k.startswith("sk-"), k.rlike(r"^sk-[A-Za-z0-9_-]{29,}$")).otherwise(k.rlike(r"^[A-Za-z0-9]{32,}$")), F.lit(False))


def jsdoc_blocks(code: Column | str) -> Column:
    """Documentation comments of C-like languages; the code itself is not returned."""
    return F.array_join(F.regexp_extract_all(_col(code), F.lit(r"/\*\*[^*]*\*+(?:[^/*][^*]*\*+)*/"), 0), "\n")


def _without_comments(code: str) -> str:
    quote, out = "", []
    for line in code.split("\n"):
        mark = '"""' if '"""' in line else "'''" if "'''" in line else ""
        if mark:
            quote = ("" if quote in line else quote) if quote else mark
            out.append(line)
        elif quote or "#" not in line:
            out.append(line)
        elif kept := line.partition("#")[0].rstrip():
            out.append(kept)
    return "\n".join(out)


def strip_hash_comments(code: Column | str) -> Column:
    """Python lines less what follows ``#``, outside docstrings; lines that are only a comment go. One linear pass by Arrow batches."""
    return F.pandas_udf(lambda s: s.map(_without_comments), "string")(F.coalesce(_col(code), F.lit("")))


def summarise_config(text: Column | str) -> Column:
    """Redacted configuration: bracket lines stay, ``key: [configured]`` for values, blanks and comments go."""
    lines = F.split(redact_secrets(text), "\n")

    def shorten(line: Column) -> Column:
        bare = F.trim(line)
        key = F.trim(F.when(F.instr(bare, "=") > 0, F.substring_index(bare, "=", 1)).otherwise(F.substring_index(bare, ":", 1)))
        return F.when(bare.rlike(r"[\[\]{}]"), line).when(bare.rlike("[=:]"), F.concat(key, F.lit(": [configured]")))

    kept = F.filter(lines, lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))
    return F.array_join(F.array_compact(F.transform(kept, shorten)), "\n")
