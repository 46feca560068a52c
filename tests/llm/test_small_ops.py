"""Edge cases and brute force for operators 1 to 7, 9 and 10 on small frames."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemill.llm import chat, decontam, exact_dedup, langid, mixing, quality, secrets, toxicity, warc
from sievemill.llm.bytesops import Words, text_blocks
from sievemill.llm.shared import ROW, SRC, Scratch, identified, split_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   ", "a", "Ünïcode ßtraße " * 3, "x" * 200_000, "word " * 40_000, "\x00\x01 nul", "a", None]


def docs_of(spark, texts, **extra):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return df


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def test_words_match_the_pattern():
    for lo, hi, buf, offsets in text_blocks(pa.array(ODD, pa.string())):
        w = Words(buf, offsets)
        raw = w.low.tobytes()
        for d in range(lo, hi):
            a, b = w.bounds[d - lo], w.bounds[d - lo + 1]
            assert [raw[s:e].decode() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)] == words(ODD[d])


def brute_hits(text, items, window=10):
    ws, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        m = min(window, len(iw))
        wins = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)} if m else set()
        for i in range(len(ws) - m + 1) if m else []:
            if tuple(ws[i : i + m]) in wins:
                hit.update(range(i, i + m))
                found.add(str(item))
    return len(ws), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)] + ["É", "Über", "42"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(3, "same id twice " * 5), (99, None)]
    texts = ODD + [" ".join(rng.choices(vocab, k=rng.randint(0, 300))) for _ in range(40)]
    texts += ["- ".join(words(t)) + " tail" for _, t in items[:12]] + ["pre " + (t or "").upper() for _, t in items]
    df = docs_of(spark, texts, contamination="clash", hits=1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = df.withColumn("_sm_src", F.lit("clash")).withColumn("_sm_ids", F.lit("clash"))
    for limit in (decontam.MAX_BENCHMARK_BYTES, 100):  # one pass, and several
        out = decontam.decontaminate(df, bench, max_benchmark_bytes=limit)
        got = out.collect()
        assert len(got) == len(texts) and out.columns == [*(c for c in df.columns if c != "contamination"), "contamination"]
        for r in got:
            c = r.contamination
            assert (c.n_words, c.n_hit, c.item_ids) == brute_hits(r.text, items), r.doc_id
    assert decontam.decontaminate(df, bench.limit(0)).filter("contamination.n_hit > 0").count() == 0
    assert decontam.decontaminate(df.limit(0), bench).count() == 0


def test_the_automaton_is_compact():
    """Under 12 bytes for each byte of benchmark text, besides the shift table, whose size is bounded."""
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 9))) for _ in range(5000)]
    items = [(i, " ".join(rng.choices(vocab, k=300))) for i in range(500)] + [(i, " ".join(rng.choices(vocab[:5], k=40))) for i in range(500, 520)]
    m = decontam.WuManber(items)
    text = sum(len(t) for _, t in items)
    assert sum(x.nbytes() - x.shift.nbytes for x in m.lengths) + len(m.text) < 12 * text
    assert all(x.shift.nbytes <= 1 << 24 for x in m.lengths)
    docs = [" ".join(rng.choices(vocab[:5], k=400)) for _ in range(4)] + [items[3][1], "x " + items[7][1][100:900] + " y"]
    at = 0
    for n, hits, found, _, _ in m.scan(pa.array(docs)):
        for d in range(len(n)):
            assert (int(n[d]), int(hits[d]), sorted(found[d])) == brute_hits(docs[at], items)
            at += 1
    assert at == len(docs)


PAYLOADS = ["<a>", None, "", "x WARC/1.1\r\n inside", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "<a>", "ü" * 1000, "end\r\n\r\n", "WARC/1.1\r\n" * 5, ""]
_EMBEDDED = "WARC/1.1\r\nContent-Length: 2\r\n\r\nxy\r\n\r\n"
PAYLOADS += [f"x WARC/1.1\r\nContent-Length: {n}\r\n\r\nabc" for n in (3_000_000_000, -5, 10**18, "9" * 40, "x")]
PAYLOADS += [_EMBEDDED * 3, _EMBEDDED[:-4], "WARC/1.0\r\n\r\n", "WARC/1.", "WARC/1.7\r\nContent-Length: 0\r\n\r\n", "long " * 200_000, "p" * 300 + _EMBEDDED * 40]


@pytest.mark.parametrize(("split", "stretch"), [("134217728", 1 << 26), ("97", 64), ("5000", 700)])
def test_warc_round_trip(spark, monkeypatch, split, stretch):
    monkeypatch.setattr(warc, "STRETCH", stretch)
    payloads = [p for p in PAYLOADS if split != "97" or len(p or "") < 2500]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\nBad: 1", p) for i, p in enumerate(payloads)] + [(None, None, "<a>")], "page_id long, url string, html string").withColumn("block", F.lit(1))
    scratch = Scratch(spark, "t")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        warc.write_warc(pages, scratch.path("a"), scratch, records_per_file=4)
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = warc.read_warc(spark, scratch.path("a"), scratch).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    import base64

    rows = {r.page_id: r for r in got}
    assert len(got) == len(payloads) + 1
    for i, p in [*enumerate(payloads), (None, "<a>")]:
        raw = (p or "").encode()
        same = [j for j, q in enumerate(payloads) if (q or "") == (p or "")]
        assert rows[i].payload_bytes == len(raw) and rows[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        kept = i == max(same)
        assert rows[i].record_type == ("response" if kept else "revisit") and rows[i].refers_to == (None if kept else max(same))
    empty = Scratch(spark, "t")
    warc.write_warc(pages.limit(0), empty.path("a"), empty)
    assert warc.read_warc(spark, empty.path("a"), empty).count() == 0


def _warc(kind, block, version="1.0", head=""):
    return f"WARC/{version}\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_warc_files_of_others(spark, tmp_path):
    """Version 1.0, records that hold no HTTP, bytes that are no UTF-8, gzip, cut files, files that are no archives."""
    import gzip

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\xff\xfe</p>"
    records = [_warc("warcinfo", b"software: x\r\n"), _warc("response", http, head="WARC-Page-ID: 7\r\nContent-Type: application/http; msgtype=response\r\n"), _warc("resource", b"WARC/1.0\r\n", "1.1")]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    with gzip.open(tmp_path / "b.warc.gz", "wb") as f:
        f.write(b"".join(records))
    (tmp_path / "cut.warc").write_bytes(records[0] + records[1][:-9])
    (tmp_path / "shift.warc").write_bytes(b"junk" + records[0])
    (tmp_path / "none.warc").write_bytes(b"no archive")
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "nolength.warc").write_bytes(records[0] + b"WARC/1.0\r\nWARC-Type: response\r\n\r\nx\r\n\r\n" + records[1])
    got = sorted((r.record_type, r.payload_bytes, r.page_id) for r in warc.read_warc(spark, str(tmp_path), Scratch(spark, "t")).collect())
    whole = [("resource", 10, None), ("response", 9, 7), ("warcinfo", 13, None)]
    assert [x for x in got if x[0] == "resource"] == whole[:1] * 2
    assert [x for x in got if x[0] == "warcinfo"] == whole[2:] * 4
    assert sorted(x for x in got if x[0] == "response" and x[2] == 7) == [("response", 4, 7), ("response", 9, 7), ("response", 9, 7)]


TURNS = [(1, 0, "user", "hi \\ [INST] </s>"), (1, 1, "assistant", None), (2, 0, "assistant", "<s><s>s> [/INST"), (2, 0, "tool", "[ROLE] x\ny"), (3, 0, None, "\\"), (4, 1, "user", "a"), (4, 1, "user", "a"), (None, 0, "system", ""), (5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "long " * 30_000), (6, 0, "a\nb", "[\\INST]")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_chat(df)
    rows = {r.conv_id: r for r in out.select("*", chat.read_chat(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    for conv in {t[0] for t in TURNS}:
        mine = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1], t[2] is not None, t[2] or "", t[3] or ""))
        assert [(b.role, b.text) for b in rows[conv].back] == [(t[2], t[3] or "") for t in mine], conv
        assert rows[conv].loss == "".join(t[3] or "" for t in mine if t[2] == "assistant")
        assert "".join(s.text for s in rows[conv].segments) == rows[conv].formatted
    assert {c: (r.valid, r.error_turn) for c, r in rows.items()} == {1: (True, None), 2: (False, 0), 3: (False, 0), 4: (False, 1), None: (False, 1), 5: (True, None), 6: (False, 0)}
    digest = chat.digest_columns(out)
    assert "aggregate(" in digest._jdf.queryExecution().optimizedPlan().toString()  # the machine's fold
    for r in digest.collect():
        assert (r.valid, r.error_turn) == (rows[r.conv_id].valid, rows[r.conv_id].error_turn)
        assert r.loss_sha256 == hashlib.sha256(rows[r.conv_id].loss.encode()).hexdigest()
        assert r.flags_sha256 == hashlib.sha256("".join(str(int(s.loss)) for s in rows[r.conv_id].segments).encode()).hexdigest()
    lone = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(lone).count() == 2
    assert chat.format_chat(df.limit(0)).count() == 0


def test_golomb_codes():
    rng = np.random.default_rng(1)
    for values in (np.empty(0, np.uint64), np.array([0], np.uint64), np.array([0, 1, 2, 2**62], np.uint64), np.sort(rng.integers(0, 1 << 40, 3000, dtype=np.uint64))):
        k, code = exact_dedup.golomb_encode(values)
        assert (exact_dedup.golomb_decode(len(values), k, code) == values).all()
    assert len(code) < 3000 * 8 / 1.8


def test_exact_groups_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = ODD + [rng.choice(["one two", "one  two", "one\t\ntwo", "other", " lead", "lead "]) for _ in range(60)]
    df = docs_of(spark, texts, keep_id="clash", _metadata="clash").union(spark.createDataFrame([(None, "other", "en", "s", 0, "clash", "clash"), (0, "a", "en", "s", 0, "clash", "clash")], DOCS + ", keep_id string, _metadata string"))
    df.repartition(3).write.parquet(f"{tmp_path}/d")
    scratch = Scratch(spark, "t")
    for frame in (spark.read.parquet(f"{tmp_path}/d"), df):
        rows = exact_dedup.exact_groups(identified(frame, scratch), scratch).collect()
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        groups: dict = {}
        for r in df.collect():
            groups.setdefault(hashlib.sha256(norm(r.text).encode()).hexdigest(), []).append(r.doc_id)
        assert len(rows) == df.count()
        for r in rows:
            ids = groups[r.text_sha256]
            assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
        assert sum(r.kept for r in rows) == len(groups)
        left = exact_dedup.exact_dedup(frame)
        assert left.columns == frame.columns and left.count() == len(groups)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_split_rows_in_blocks(spark, tmp_path, monkeypatch):
    from sievemill.llm import shared

    spark.range(50_000).repartition(5).write.parquet(f"{tmp_path}/d")
    scratch = Scratch(spark, "t")
    rows = identified(spark.read.parquet(f"{tmp_path}/d"), scratch)
    chosen = rows.filter("id % 7 = 0").select(SRC, ROW)
    for limit in (1 << 15, 2):
        monkeypatch.setattr(shared, "MAX_BITMAPS", limit)
        ins, outs = split_rows(rows, chosen, scratch, f"b{limit}")
        assert ins.filter("id % 7 != 0").count() == 0 and ins.count() + outs.count() == 50_000 and outs.filter("id % 7 = 0").count() == 0


def brute_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 8:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


SECRET_TEXTS = [
    "token=secret: abcdefgh12", "ToKeN = 'abcdefgh'", "api_key:short", "é token==abcdefgh", "AKIA" + "A1" * 6, "AKIA" + "A1" * 5 + "AKIA" + "B" * 12, "f" * 31 + " " + "0" * 32, "password: " + "a" * 40,
    "user=alice\nQm9yaW5nLXNlY3JldC1CeXRlczEyMzQ1\nhttps://db.example.com/x", "user=alice\n\nQm9yaW5nLXNlY3JldC1CeXRlczEyMzQ1", "Qm9yaW5nLXNlY3JldC1CeXRlczEyMzQ1", "ſecret=abcdefghij",
]


def test_secrets_against_brute_force(spark):
    texts = ODD + SECRET_TEXTS
    rows = secrets.scan_secrets(docs_of(spark, texts, secrets="clash")).collect()
    for r in rows:
        assert [(s.start, s.end, s.kind) for s in r.secrets if s.base] == brute_base(r.text or ""), r.text
    kinds = {r.text: [s.kind for s in r.secrets if not s.base] for r in rows}
    assert kinds[SECRET_TEXTS[8]] == ["ident", "opaque", "endpoint"]  # parts of one paragraph
    assert kinds[SECRET_TEXTS[9]] == [] and kinds[SECRET_TEXTS[10]] == []  # other scope, no partner
    assert secrets.scan_secrets(docs_of(spark, [])) .count() == 0


def brute_links(text):
    """Weak parts that share a paragraph with a part of the complementary kind, by comparing all parts with all."""
    import math
    from collections import Counter

    parts = [(a, b, {"assign": "secret", "hex": "secret", "access": "ident"}[k], k) for a, b, k in brute_base(text)]
    ident = r"""(?:user(?:name)?|login|client_?id|account|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{3,})"""
    parts += [(m.start(), m.end(), "ident", "ident") for m in re.finditer(ident, text, re.I | re.A)]
    parts += [(m.start(), m.end(), "endpoint", "endpoint") for m in re.finditer(secrets.ENDPOINT.pattern.decode(), text)]
    taken = list(parts)
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        bits = -sum(c / len(m.group()) * math.log2(c / len(m.group())) for c in Counter(m.group()).values())
        if bits >= 3.5 and not any(a < m.end() and m.start() < b for a, b, *_ in taken):
            parts.append((m.start(), m.end(), "secret", "opaque"))
    ends = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    scope = lambda a, b: set(range(sum(e <= a for e in ends), max(sum(e < b for e in ends), sum(e <= a for e in ends)) + 1))
    need = {"secret": {"ident", "endpoint"}, "ident": {"secret"}, "endpoint": {"secret"}}
    out = [(a, b, k) for a, b, role, k in parts if k in ("ident", "endpoint", "opaque") and any(r in need[role] and scope(a, b) & scope(c, d) for c, d, r, _ in parts)]
    return sorted(out)


def test_linked_secrets_against_brute_force():
    rng = random.Random(11)
    pieces = ["user=alice", "login: bob99", "https://db.example.com/x", "host = db-1", "Qm9yaW5nLXNlY3JldC1CeXRlczEyMzQ1", "token = abcdefgh12", "AKIA" + "A1" * 8, "f0" * 16, "plain words", "a" * 25, "account:x", "é ü", "client_id='zzz'"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) + rng.choice([" ", "\n", "\n\n", "\n \t\n"]) for _ in range(rng.randint(1, 9)))
        assert sorted((a, b, k) for a, b, k, base in secrets.scan_text(text) if not base) == brute_links(text), text


def test_mixing(spark):
    rows = [(i, "x" * 10, "en", "big" if i % 4 else "small", 0) for i in range(4000)] + [(9000, None, "en", None, 0), (9001, "", "en", "void", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("copy", F.lit("clash"))
    out = mixing.mix_sources(df, weights={"big": 0.5, "small": 0.5})
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] / 2000 - 1) < 0.08 and abs(n["small"] / 2000 - 1) < 0.08 and None not in n
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "mix_key"]
    assert n["void"] == 0 if "void" in n else True  # a weight of 0 leaves it out
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix_sources(df.repartition(7), weights={"big": 0.5, "small": 0.5}).collect()))
    many = mixing.mix_sources(df.filter("source = 'small'"), epochs=40.0)  # a mean above MAX_MEAN is a sum of draws
    assert abs(many.count() / 40_000 - 1) < 0.05
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_mixing_draws_as_plain_python_does(spark):
    """Counts are the inverse Poisson distribution at numbers hashed from seed and id; sources without characters keep rate epochs."""
    import math

    rows = [(i, "x" * (1 + i % 7), "en", f"s{i % 3}", 0) for i in range(300)] + [(1000 + i, None if i % 2 else "", "en", "empty", 0) for i in range(40)] + [(None, "abc", None, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    for epochs in (1.0, 50.0):
        size = {}
        for _, text, _, source, _ in rows:
            size[source] = size.get(source, 0) + len(text or "")
        roots, total = sum(math.sqrt(s) for s in size.values() if s), sum(size.values())
        want = {}
        for doc, _, _, source, _ in rows:
            rate = epochs * math.sqrt(size[source]) / roots * total / size[source] if size[source] else epochs
            parts, count = max(1, math.ceil(rate / 16)), 0
            for i in range(1, parts + 1):
                u = int(hashlib.md5(f"17/{'null' if doc is None else doc}/{i}".encode()).hexdigest()[:13], 16) / 2**52
                p = c = math.exp(-rate / parts)
                for k in range(1, 81):
                    if c > u:
                        break
                    count += 1
                    p *= rate / parts / k
                    c += p
            want[doc] = count
        out = mixing.mix_sources(df, epochs=epochs)
        assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {d: c for d, c in want.items() if c}
        assert out.groupBy("doc_id", "copy").count().filter("count > 1").count() == 0
        assert sum(want[1000 + i] for i in range(40)) > 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 4


def test_ordinal_regression_orders_grades(spark):
    rng = random.Random(2)
    rows, grades = [], []
    for i in range(600):
        g = i % 4
        rows.append((i, " ".join(rng.choices(["good"] * (1 + 3 * g) + ["bad"] * (10 - 3 * g) + ["the", "of", "x"], k=60)), "en", "s", 0))
        grades.append((i, g))
    df, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*grades, (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit_quality(df.filter("doc_id < 400"), labels)
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    got = quality.score_quality(df.filter("doc_id >= 400"), model).collect()
    error = np.mean([abs(r.expected_grade - r.doc_id % 4) for r in got])
    assert error < 0.5
    odd = quality.score_quality(docs_of(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.tail_probability <= 1 for r in odd)
    none = quality.fit_quality(df, labels.limit(0))
    assert quality.score_quality(df, none).first().expected_grade is None
    assert quality.score_quality(df.limit(0), model).count() == 0


def test_ordinal_likelihood_is_at_its_maximum():
    """The penalised likelihood's slope, taken by differences, is nil at the fit, and no small step makes it better."""
    rng = np.random.default_rng(5)
    n, m = 300, 12
    rows = [np.sort(rng.choice(m, rng.integers(2, 6), replace=False)) for _ in range(n)]
    indptr, index = np.cumsum([0, *map(len, rows)]), np.concatenate(rows)
    value = np.ones(len(index))
    effect = rng.normal(size=m)
    grade = np.digitize([effect[r].sum() / np.sqrt(len(r)) + rng.logistic() for r in rows], [-1.0, 0.5])
    model = quality.fit_ordinal(indptr, index, value, grade, bits=4)
    unit = quality.unit_rows(indptr, value)

    def loss(w, theta):
        w = np.append(w, np.zeros(16 - len(w)))
        eta = np.bincount(np.repeat(np.arange(n), np.diff(indptr)), unit * w[index], n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        cdf = lambda x: 1 / (1 + np.exp(-np.clip(x, -35, 35)))
        p = cdf(edges[grade + 1] - eta) - cdf(edges[grade] - eta)
        return -np.log(p).mean() + 0.5e-3 / n * (w * w).sum()

    x = np.concatenate([model.weights[:m], model.thresholds])
    at = lambda z: loss(z[:m], z[m:])
    steps = 1e-5 * np.eye(m + 2)
    assert max(abs(at(x + s) - at(x - s)) / 2e-5 for s in steps) < 1e-4
    assert all(at(x + 0.05 * rng.normal(size=m + 2)) > at(x) for _ in range(100))


def test_quality_of_held_out_rows(spark):
    """At sf0.1: grades of rows that were not learned from are told far better than by their mean."""
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = quality.fit_quality(docs, labels.filter(~toxicity.held_out()))
    got = quality.score_quality(docs.filter(toxicity.held_out()), model).join(labels, "doc_id").select("expected_grade", "quality").collect()
    x, y = np.array([r.expected_grade for r in got]), np.array([r.quality for r in got], float)
    assert len(got) > 500 and np.corrcoef(x, y)[0, 1] > 0.5 and np.abs(x - y).mean() < 0.6 * np.abs(y - y.mean()).mean()


def test_language(spark):
    en, de = "the quick brown fox and the lazy dog with this and that ", "der schnelle braune fuchs und der faule hund mit dieser und jener "
    rows = [(i, (en if i % 2 else de) * 3, "en" if i % 2 else "de", "s", 0) for i in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.learn_profiles(df.filter("doc_id < 20"))
    assert all(r.lang_pred == r.lang and 0 < r.lang_score <= 1 for r in langid.predict_language(df, model).collect())
    odd = langid.predict_language(docs_of(spark, [*ODD, "123 !?"], lang_pred="clash"), model).collect()
    assert [r.lang_pred == "und" for r in odd] == [t is None or not re.search(r"[^\W\d_]", t) for t in [*ODD, "123 !?"]]
    nothing = langid.learn_profiles(df.filter("lang is null"))
    assert {r.lang_pred for r in langid.predict_language(df, nothing).collect()} == {"und"}


def plain_grams(text):
    """Letter n-grams of one to three letters with marks, from characters alone."""
    import unicodedata
    from collections import Counter

    out, words_ = Counter(), "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower()).split()
    for w in words_:
        out.update(w)
        marked = f"_{w}_"
        out.update(marked[i : i + 2] for i in range(len(marked) - 1))
        out.update(marked[i : i + 3] for i in range(len(marked) - 2))
    return out


def test_language_distances_against_brute_force(spark, monkeypatch):
    """Ranks, distances and choices as plain Python gives them, in letters of several scripts; in one pass and in several."""
    rng = random.Random(2)
    scripts = {"en": "etaoin shrdlu", "ru": "оеаинт сорвл", "el": "αοιετσν ηυρπ", "fr": "éàeasit nruôl", "zh": "的一是不了人 我在有他"}
    make = lambda lang, n: "".join(rng.choices(scripts[lang], k=n))
    rows = [(i, make(lang, rng.randint(5, 200)), lang, "s", 0) for i, lang in enumerate(list(scripts) * 12)]
    rows += [(100 + i, t, "en", "s", 0) for i, t in enumerate(["ß—“quoted” it’s", "12 34", None, "", "é" * 3, "e\u0301a", "same", "same"])]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    number = langid._letters()
    code = lambda g: sum((1 if c == "_" else int(number[ord(c)])) << (18 * k) for k, c in enumerate(reversed(g)))
    ranked = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:40]
    from collections import Counter

    profiles = {}
    for lang in scripts:
        total = Counter()
        for r in rows:
            if r[2] == lang:
                total.update(plain_grams(r[1]))
        profiles[lang] = {g: i for i, g in enumerate(ranked(total))}
    want = {}
    for doc, text, *_ in rows:
        mine = ranked(plain_grams(text))
        dist = {x: sum(min(abs(p[g] - i), 40) if g in p else 40 for i, g in enumerate(mine)) for x, p in profiles.items()}
        best = min(sorted(dist), key=dist.get)
        want[doc] = (best, 1 - dist[best] / (40 * len(mine))) if mine else ("und", 0.0)
    for languages in (2000, 2):
        monkeypatch.setattr(langid, "LANGUAGES", languages)
        model = langid.learn_profiles(df, size=40)
        got = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.predict_language(df, model, size=40).collect()}
        assert got.keys() == want.keys()
        for doc, (lang, score) in want.items():
            assert got[doc][0] == lang and abs(got[doc][1] - score) < 1e-9, doc


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.learn_profiles(docs.filter(~held))
    got = langid.predict_language(docs.filter(held), model).collect()
    assert len(got) > 250 and np.mean([r.lang_pred == r.lang for r in got]) > 0.98


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    hit, noise = np.array([0.8, 0.6, 0.5, 0.7]), np.array([0.02, 0.01, 0.05, 0.03])
    votes = (rng.random((4000, 4)) < np.where(y[:, None], hit, noise)).astype(float)
    twin = np.concatenate([votes, votes[:, :1]], 1)  # a copy of the first voter
    m = toxicity.fit_label_model(votes, 0.2)
    assert np.abs(m.hit - hit).max() < 0.12 and abs(m.prior - 0.2) < 0.05
    assert toxicity.fit_label_model(twin, 0.2).correlation[0, 4] > 0.8
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.95


def test_label_model_with_voters_that_abstain():
    """Two groups of voters, each speaking on half of the rows: one's silence is no evidence about the other's rows."""
    rng = np.random.default_rng(3)
    y, half = rng.random(4000) < 0.15, np.arange(4000) % 2
    votes = np.full((4000, 6), -1)
    for j in range(6):
        mine = half == j // 3
        votes[mine, j] = rng.random(mine.sum()) < np.where(y[mine], 0.8, 0.03)
    m = toxicity.fit_label_model(votes, 0.15)
    assert np.abs(m.hit - 0.8).max() < 0.08 and np.abs(m.noise - 0.03).max() < 0.03
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.97
    silent = m.posterior(np.full((1, 6), -1))
    assert abs(silent[0] - m.prior) < 1e-9


def test_voters_are_of_one_kind_and_context():
    """Words of two languages: entries are grouped by the toxic rows they share, and each group speaks in its own language only."""
    rng = random.Random(7)
    texts, y = [], []
    for i in range(1200):
        lang, toxic = i % 2, i % 10 in (3, 4)
        words_ = rng.choices([f"{'ab'[lang]}word{k}" for k in range(60)], k=50) + ["the" if lang else "und"] * 3
        texts.append(" ".join(words_ + (rng.sample([["vile", "scum", "filth"], ["mist", "dreck", "pack"]][lang], 2) if toxic else [])))
        y.append(float(toxic))
    lists = [toxicity.features_of(buf, offsets) for _, _, buf, offsets in text_blocks(pa.array(texts))]
    assert len(lists) == 1
    row, index, density = lists[0]
    used, n = np.unique(index, return_counts=True)
    common = used[(n > 100) & (n < 1100)]
    has = np.zeros((1200, len(common)), bool)
    on = np.isin(index, common)
    has[row[on], np.searchsorted(common, index[on])] = True
    voters = toxicity.learn_voters(row, index, density, np.array(y), common, has)
    assert {v.kind for v in voters} >= {"word", "short"} and len({v.context for v in voters}) >= 2
    votes = toxicity.cast_votes(voters, row, index, density, common, has)
    assert (np.unique(votes) == [-1, 0, 1]).all()
    model = toxicity.fit_label_model(votes, float(np.mean(y)))
    assert ((model.posterior(votes) > 0.5) == np.array(y, bool)).mean() > 0.98


def test_held_out_recall_and_precision_on_the_test_tables(spark):
    """At sf0.1: most held-out toxic rows are found, hardly a clean one is taken."""
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    scored = toxicity.score_toxicity(docs.filter(toxicity.held_out()).select("doc_id", "text"), model).join(labels, "doc_id")
    n = {(r.toxic, r.toxic_predicted): r["count"] for r in scored.groupBy("toxic", "toxic_predicted").count().collect()}
    found, missed, false = n.get((1, 1), 0), n.get((1, 0), 0), n.get((0, 1), 0)
    assert found / (found + missed) > 0.85 and found / (found + false) > 0.95


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    plain, bad = [f"w{i}" for i in range(200)], ["vile", "scum", "filth"]
    rows = [(i, " ".join(rng.choices(plain, k=80) + (rng.sample(bad, 2) if i % 5 == 3 else [])), "en", "s", 0) for i in range(1500)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 5 == 3)) for i in range(1500)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(df, labels)
    got = toxicity.score_toxicity(df.filter(toxicity.held_out()), model).collect()
    assert len(got) > 200 and np.mean([r.toxic_predicted == int(r.doc_id % 5 == 3) for r in got]) > 0.97
    odd = toxicity.score_toxicity(docs_of(spark, ODD, toxic_score="clash"), model).collect()
    assert len(odd) == len(ODD) and all(r.toxic_predicted == 0 and 0 <= r.toxic_score <= 1 for r in odd)
    empty = toxicity.fit_toxicity(df, labels.limit(0))
    assert toxicity.score_toxicity(df, empty).filter("toxic_predicted = 1").count() == 0
