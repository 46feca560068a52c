"""Overlaps of all documents, not only those of low ids."""

import random
from itertools import combinations

from sievemill.plans.catalogue import QUERIES


def test_overlaps_beyond_the_first_hundred_documents(spark, tmp_path):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    common, texts = rng.choices(vocab, k=25), []
    for i in range(160):
        texts.append(" ".join(rng.choices(vocab, k=60) + (common if i % 2 else common[: rng.randrange(25)])))
    texts += [t.upper() + " end" for t in texts[100:120]] + [None, "", "one two"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    truth = {(i, j, len(sets[i] & sets[j])) for i, j in combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 20}
    assert any(i >= 100 for i, _, _ in truth)
    assert {(r.a, r.b, r.shared) for r in QUERIES["shingle_overlap"](spark, str(tmp_path)).collect()} == truth
