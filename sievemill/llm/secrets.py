"""Secret scans with multipart credential linking.

Base patterns are reported wherever they occur. Parts that are weak on their own (an identifier, a secret-like
string, an endpoint) are joined to each other by interval: each part reaches over its scope, the paragraph it
stands in, and it is reported only when parts of another kind reach into the same scope.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed patterns and least lengths of the base kinds, in the order that breaks ties.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")  # runs are maximal, so this is [0-9a-f]+ of 32 or more
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
#: Weak parts, fixed patterns.
IDENT = re.compile(rb"""(?i:user(?:name)?|login|client_?id|account|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{3,})""")
ENDPOINT = re.compile(rb"(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqps?|mongodb(?:\+srv)?)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|(?i:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9][A-Za-z0-9._:-]{2,})")
OPAQUE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "ident", "endpoint", "opaque")
#: Kinds of parts by role: a link needs a secret and an identifier, or a secret and an endpoint.
ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "ident", "ident": "ident", "endpoint": "endpoint"}
#: Least Shannon entropy, in bits a character, of an opaque string.
LEAST_ENTROPY = 3.5
SCOPE_END = re.compile(rb"\n[\x20\t\r]*\n")


def entropy(s: bytes) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def base_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the base kinds, byte offsets: leftmost, not overlapping within a kind, failing ones dropped."""
    low = raw.lower()
    out = []
    if any(w in low for w in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(raw)]
    return out


def linked_spans(raw: bytes, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak parts that share a scope with a part of the complementary kind."""
    low = raw.lower()
    weak: list[tuple[int, int, str]] = []
    if any(w in low for w in (b"user", b"login", b"client", b"account", b"access")):
        weak += [(m.start(), m.end(), "ident") for m in IDENT.finditer(raw)]
    if b"://" in low or any(w in low for w in (b"host", b"endpoint", b"server")):
        weak += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(raw)]
    if not weak and not any(k == "access" for _, _, k in base):
        return []  # a secret-like string needs an identifier or an endpoint beside it
    taken = sorted([*base, *weak])
    starts = [t[0] for t in taken]
    reach = np.maximum.accumulate([t[1] for t in taken]).tolist() if taken else []
    for m in OPAQUE.finditer(raw):
        at = bisect.bisect_left(starts, m.end()) - 1
        if (at < 0 or reach[at] <= m.start()) and entropy(m.group()) >= LEAST_ENTROPY:
            weak.append((m.start(), m.end(), "opaque"))
    # the join: scopes are disjoint intervals, a part reaches into each scope it overlaps
    ends = [m.start() for m in SCOPE_END.finditer(raw)]
    roles: dict[int, set[str]] = {}
    spread = []
    for part in [*base, *weak]:
        lo, hi = bisect.bisect_right(ends, part[0]), bisect.bisect_left(ends, part[1])
        spread.append((lo, max(lo, hi)))
        for scope in range(lo, max(lo, hi) + 1):
            roles.setdefault(scope, set()).add(ROLE[part[2]])
    need = {"secret": {"ident", "endpoint"}, "ident": {"secret"}, "endpoint": {"secret"}}
    return [
        part
        for part, (lo, hi) in zip([*base, *weak], spread, strict=True)
        if part[2] in ("ident", "endpoint", "opaque") and any(roles[s] & need[ROLE[part[2]]] for s in range(lo, hi + 1))
    ]


def _points(raw: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Byte offsets to code points, in order of start, then kind."""
    spans = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    if not spans or raw.isascii():
        return spans
    firsts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [(int(np.searchsorted(firsts, a)), int(np.searchsorted(firsts, b)), k) for a, b, k in spans]


def scan_text(text: str | bytes | None) -> list[tuple[int, int, str, bool]]:
    """``(start, end, kind, base)`` of all spans of one text, in code points; null is empty."""
    raw = text if isinstance(text, bytes) else (text or "").encode()
    base = base_spans(raw)
    return [(a, b, k, k in KINDS[:3]) for a, b, k in _points(raw, base + linked_spans(raw, base))]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("base", T.BooleanType())]))


def scan_secrets(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` plus ``secrets``: array<struct<start, end, kind, base>> over the whole text.

    One row for each input row; null and empty texts have no spans; offsets are code points, ends exclusive.
    Spans are ordered by start, then kind. A column that is already named ``secrets`` is replaced; others pass through.
    Nothing is shuffled: scopes never reach beyond their document.
    """
    docs = docs.drop("secrets")
    at = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary()).to_pylist()
            rows = [[dict(zip(("start", "end", "kind", "base"), s, strict=True)) for s in scan_text(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "secrets"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("secrets", SPANS)]))


def digest_columns(scanned: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    from pyspark.sql import functions as F

    s = F.col("secrets")
    line = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    joined = lambda c: F.array_join(F.transform(c, line), ",")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.filter(s, lambda x: x["base"])), 256).alias("base_sha256"), joined(s).alias("spans"))
