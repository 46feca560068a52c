"""Near duplicates against brute force, and the pipeline stage by stage."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievemill.llm import neardup as nd
from sievemill.llm.shared import ROW, SRC, Scratch, identified

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall((text or "").lower())


def plain_vectors(texts):
    """TF-IDF vectors from words alone, sharing no code with the operator: document frequencies over distinct sequences of words."""
    grams = []
    for t in texts:
        w = words_of(t)
        grams.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    distinct = {tuple(words_of(t)): g for t, g in zip(texts, grams, strict=True) if g}
    df = Counter(s for g in distinct.values() for s in g)
    n = len(distinct)
    return [{s: c * (1 + math.log(n / df[s]) / math.log(max(2, n))) for s, c in g.items()} for g in grams]


def plain_similarity(a, b):
    if not a or not b:
        return 0.0
    least = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return least / (sum(a.values()) + sum(b.values()) - least)


def true_classes(ids, texts, threshold=0.8):
    """All pairs by weighted Jaccard, then components."""
    v = plain_vectors(texts)
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            if plain_similarity(v[i], v[j]) >= threshold:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[find(i)].append(i)
    return {ids[i]: min(ids[j] for j in g) for g in groups.values() for i in g}


def corpus(seed=1, groups=12, size=6):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(800)]
    passage = rng.choices(vocab, k=60)
    texts = []
    for _ in range(groups):
        base = rng.choices(vocab, k=150)
        texts.append(" ".join(base))
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(10**6))
            texts.append(" ".join(copy))
    texts += [" ".join(rng.choices(vocab, k=80) + passage) for _ in range(30)]
    texts += [None, "", "!!", "one two", "One, two!", "one", "one two three four five", "zwölf " * 5000]
    rng.shuffle(texts)
    return texts


def test_classes_against_brute_force(spark, tmp_path):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).withColumn("class_id", F.lit("clash"))
    df.repartition(3).write.parquet(f"{tmp_path}/d")
    scratch = Scratch(spark, "t")
    rows = nd.near_groups(identified(spark.read.parquet(f"{tmp_path}/d"), scratch), scratch).collect()
    truth = true_classes(list(range(len(texts))), texts)
    assert {r.doc_id: r.class_id for r in rows} == truth
    assert sum(r.kept for r in rows) == len(set(truth.values())) and all(r.kept == (r.doc_id == r.class_id) for r in rows)
    left = nd.near_dedup(spark.read.parquet(f"{tmp_path}/d"))
    assert left.columns == df.columns and left.count() == len(set(truth.values()))
    assert nd.near_dedup(df.limit(0)).count() == 0


def test_pairs_in_a_large_family_that_is_less_alike(spark, tmp_path):
    """600 texts of one template, about 0.65 alike, and near 0.86 in pairs: the hub of a bucket is like neither of a pair."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(5000)]
    head, tail = rng.choices(vocab, k=110), rng.choices(vocab, k=109)
    slots = [rng.choices(vocab, k=31) for _ in range(540)]
    slots += [s[:23] + rng.choices(vocab, k=8) for s in slots[:60]]
    family = [" ".join(head + s + tail) for s in slots]
    texts = family + [" ".join(rng.choices(vocab, k=8)) for _ in range(2600)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    v = plain_vectors(texts)[: len(family)]
    alike = {(i, j) for j in range(len(v)) for i in range(j) if plain_similarity(v[i], v[j]) >= 0.8}
    assert alike == {(i, 540 + i) for i in range(60)} and 0.6 < plain_similarity(v[100], v[101]) < 0.8
    scratch = Scratch(spark, "t")
    rows = nd.near_groups(identified(spark.read.parquet(f"{tmp_path}/d"), scratch), scratch).collect()
    assert {(r.class_id, r.doc_id) for r in rows if r.class_id != r.doc_id} == alike


@pytest.mark.parametrize("block", [2, 7, 128])
def test_blocks_of_a_bucket_meet_in_all_pairs(spark, monkeypatch, block):
    """Whatever the size of blocks, each pair of different classes is met once: 30 members, 12 of them of one class, in two bands."""
    monkeypatch.setattr(nd, "BLOCK", block)
    nodes = [bytes([i]) for i in range(31)]
    texts = spark.createDataFrame([(n, "a b c d e f g", None) for n in nodes], "node binary, low string, df binary")
    signed = spark.createDataFrame([(n, [1, 2, *[100 * n[0] + k for k in range(14)]]) for n in nodes], "node binary, bands array<long>")
    members = spark.createDataFrame([(n, b, b) for n in nodes for b in (0, 1)], "node binary, band int, bucket long")
    hubs = spark.createDataFrame([(0, nodes[30]), (1, nodes[30])], "bucket long, b binary")
    labels = spark.createDataFrame([(n, nodes[0]) for n in nodes[:12]], "node binary, label binary")
    rows = nd._rest(members, hubs, labels, texts, signed, 31, 0.8, Scratch(spark, "t")).collect()
    met = [frozenset((bytes(r.a)[0], bytes(r.b)[0])) for r in rows]
    assert len(met) == len(set(met)) and set(met) == {frozenset((i, j)) for j in range(12, 30) for i in range(j)}


def test_frequencies_of_every_shingle(spark, tmp_path, monkeypatch):
    """Exact whatever the number of owners and the size of chunks and lists; long texts are chunks of their own."""
    texts = [t for t in corpus(4, groups=5) if words_of(t)] + ["lang " + "x y z " * 9000]
    truth = {}
    for t in texts:
        truth[tuple(words_of(t))] = t
    df = Counter(s for w in truth for s in {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {w})
    spark.createDataFrame([(i, t.lower()) for i, t in enumerate(truth.values())], "doc_id long, low string").repartition(3).write.parquet(f"{tmp_path}/d")
    scratch = Scratch(spark, "t")
    rows = identified(spark.read.parquet(f"{tmp_path}/d"), scratch)
    seen = []
    for owned, chunk, size in ((1 << 22, 11, 1 << 22), (300, 2, 150)):
        monkeypatch.setattr(nd, "OWNED", owned)
        monkeypatch.setattr(nd, "CHUNK_ROWS", chunk)
        monkeypatch.setattr(nd, "LIST", size)
        got = nd.signatures(rows.select(SRC, ROW, "low"), len(truth), sum(map(len, truth)), scratch).join(rows, [SRC, ROW]).collect()
        assert len(got) == len(truth)
        for r in got:
            w = words_of(r.low)
            mine = Counter(df[s] for s in ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}))
            assert Counter(nd.unpack_frequencies(r.df, sum(mine.values())).tolist()) == mine
        seen.append({r.doc_id: r.bands for r in got})
    assert seen[0] == seen[1]


@pytest.mark.parametrize("values", [[], [0], [5], [0, 255, 256], [3, 2**49, 2**50 - 1]])
def test_packed_numbers(values):
    x = np.array(values, np.uint64)
    assert nd.unpack(nd.pack(x)).tolist() == values and nd.unpack_sorted(nd.pack_sorted(x)).tolist() == values


def test_recall_against_all_pairs(spark, tmp_path):
    """Pairs between 0.8 and 0.9: every class of a brute-force comparison of all pairs is found."""
    rng = random.Random(12)
    vocab, texts = [f"w{i}" for i in range(3000)], []
    for _ in range(150):
        base = rng.choices(vocab, k=rng.randint(60, 300))
        texts.append(" ".join(base))
        copy, n = list(base), max(1, round(len(base) * rng.uniform(0.008, 0.02)))
        for at in rng.sample(range(len(copy)), n):
            copy[at] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    v = plain_vectors(texts)
    near = [(2 * i, 2 * i + 1) for i in range(150) if 0.8 <= plain_similarity(v[2 * i], v[2 * i + 1]) < 0.9]
    assert len(near) >= 30
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    scratch = Scratch(spark, "t")
    label = {r.doc_id: r.class_id for r in nd.near_groups(identified(spark.read.parquet(f"{tmp_path}/d"), scratch), scratch).collect()}
    assert sum(label[a] == label[b] for a, b in near) >= 0.97 * len(near)
    assert label == true_classes(range(300), texts)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f g"), (7, "a b c d e f g"), (7, "A b c d e f g!"), (8, None), (None, None)], "doc_id long, text string")
    scratch = Scratch(spark, "t")
    rows = nd.near_groups(identified(df, scratch), scratch).collect()
    assert len(rows) == 5 and sum(r.kept for r in rows) == 3 and {r.class_id for r in rows if r.class_size == 3} == {7}


@pytest.mark.parametrize("target", [0.3, 0.6, 0.8, 0.9])
def test_samples_agree_with_the_similarity(target):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 50, 4000, dtype=np.uint64)
    weight = dict(zip(base.tolist(), rng.choice([1.0, 2.0, 4.0], 4000), strict=True))
    k = int(4000 * target / (1 + target))
    a, b = np.sort(base[:2000]), np.sort(base[2000 - k : 4000 - k])
    va, vb = ((x, np.array([weight[i] for i in x.tolist()])) for x in (a, b))
    s = nd.Sampler(1500)
    zero = np.zeros(2000, np.int64)
    same = s.sample(zero, *va, np.array([0])) == s.sample(zero, *vb, np.array([0]))
    assert abs(same.mean() - nd.weighted_jaccard(va, vb)) < 0.04


def test_components(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("y", "x"), ("e", "d"), ("z", "e")], "a string, b string")
    got = {r.node: r.label for r in nd.components(edges, Scratch(spark, "t"), "c").collect()}
    assert got == {**dict.fromkeys("abcdez", "a"), "x": "x", "y": "x"}


def test_components_of_a_chain_of_rising_names(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(64)], "a string, b string").coalesce(1)
    assert {r.label for r in nd.components(edges, Scratch(spark, "t"), "c").collect()} == {"n00"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with planted toxic, copied, near-copied and leaked rows among clean ones."""
    base = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(9)
    vocab, bad = [f"w{i}" for i in range(3000)], ["vile", "scum", "filth"]
    item = " ".join(rng.choices(vocab, k=25))
    rows, kind = [], {}
    clean = [" ".join(rng.choices(vocab, k=120)) for _ in range(700)]
    for i, t in enumerate(clean):
        rows.append((i, t))
        kind[i] = "clean"
    for i in range(700, 900):
        rows.append((i, " ".join(rng.choices(vocab, k=60) + rng.sample(bad, 2))))
        kind[i] = "toxic"
    for i in range(900, 940):
        rows.append((i, clean[i - 900].replace(" ", "  ", 3)))
        kind[i] = "copy"
    for i in range(940, 980):
        w = clean[i - 900].split()
        w[60] = "changed"
        rows.append((i, " ".join(w)))
        kind[i] = "near"
    for i in range(980, 1000):
        rows.append((i, " ".join(rng.choices(vocab, k=50)) + " " + item + " tail"))
        kind[i] = "leak"
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], DOCS).repartition(2).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, int(kind[i] == "toxic")) for i in range(1000)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, kind


def test_each_stage_keeps_and_drops_what_it_should(spark, tables):
    base, kind = tables
    scratch = Scratch(spark, "t")
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns, gone = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = scratch.put(stage(spark, docs, base), f"s{i}")
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        gone.append(before - after)
        if i < 4:
            assert docs.columns == columns
    assert len(gone[0] ^ {i for i, k in kind.items() if k == "toxic"}) <= 5
    for n, name in ((1, "copy"), (2, "near"), (3, "leak")):
        assert gone[n] == {i for i, k in kind.items() if k == name}
    assert {"copy", "mix_key"} <= set(docs.columns) and after <= {i for i, k in kind.items() if k == "clean"}


def test_stages_take_odd_rows_and_empty_tables(spark, tables, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with the operators' own names."""
    base, _ = tables
    long = " ".join(f"w{i % 2999}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (2, "", "en", None, 0), (None, "some text of words here now", None, "s", None), (None, None, None, None, None), (3, long, "en", "s", 5), (3, long, "en", "s", 5)]
    odd = spark.createDataFrame(rows, DOCS)
    for c in ("_sm_src", "_sm_row", "copy", "contamination", "toxic_score", "class_id", "node"):
        odd = odd.withColumn(c, F.lit("clash"))
    odd.write.parquet(f"{tmp_path}/odd")
    for frame in (odd, spark.read.parquet(f"{tmp_path}/odd")):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, base)
            got = out.collect()
            if i < 4:
                assert out.columns == frame.columns, name
                assert len(got) == {0: 7, 1: 3, 2: 6, 3: 7}[i], (name, len(got))
                assert all(r.contamination == r._sm_src == "clash" for r in got)
            else:
                assert out.columns == [*(c for c in frame.columns if c != "copy"), "copy", "mix_key"]
            assert stage(spark, frame.limit(0), base).count() == 0


def test_run(spark, tables):
    base, kind = tables
    out = corpus_pipeline.run(spark, base)
    assert out.count() > 400 and {kind[r.doc_id] for r in out.select("doc_id").distinct().collect()} == {"clean"}
