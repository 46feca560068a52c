"""Redaction returns every document, whatever words stand beside the secret."""

import pytest

from sievemill.plans.catalogue import QUERIES

LONG = "Zx9" * 8
CASES = {
    "AKIA" + "A1B2" * 4: "[REDACTED_AWS]",
    "sk-" + LONG: "[REDACTED_KEY]",
    f"Authorization: Bearer {LONG}": "Bearer [REDACTED]",
    "pwd=hunter22": "pwd = [REDACTED]",
    f"jwt={LONG}": "token=[REDACTED]",
    "DATABASE_URL=postgres://host/db1": "DATABASE_URL = [REDACTED]",
    "0123456789abcdef" * 3: "[REDACTED]",
    "plain": "plain",
}


@pytest.fixture
def tables(spark, tmp_path):
    rows = list(enumerate([*CASES, f"JWT={LONG}", f"Token: {LONG}", None]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_chain_reaches_every_document(spark, tables):
    got = {r.doc_id: r.text for r in QUERIES["redact_secrets_chain"](spark, tables).collect()}
    assert len(got) == len(CASES) + 3
    for i, (text, out) in enumerate(CASES.items()):
        assert got[i] == out and (text == "plain" or text not in got[i])


def test_tokens_in_any_case(spark, tables):
    got = {r.doc_id: r.text for r in QUERIES["redact_tokens"](spark, tables).collect()}
    n = len(CASES)
    assert len(got) == n + 3 and got[n] == got[n + 1] == "token=[REDACTED]" and got[n - 1] == "plain" and got[n + 2] is None
