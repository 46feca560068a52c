import pytest
from pyspark.sql import functions as F

from sievemill.functions import classify as C
from sievemill.functions import text as T
from sievemill.plans.catalogue import IDENT_CASES, QUERY_CASES


def one(spark, value, col, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col).first()[0]


@pytest.mark.parametrize("query,kind", QUERY_CASES)
def test_classify_query(spark, query, kind):
    assert one(spark, query, C.classify_query("x")) == kind


@pytest.mark.parametrize("query,words", IDENT_CASES)
def test_identifiers(spark, query, words):
    assert " ".join(one(spark, query, C.extract_identifiers("x"))) == words


def test_file_and_context_tokens(spark):
    assert one(spark, "Find app.module.ts in foo, please", C.file_tokens("x")) == ["app.module.ts"]
    assert one(spark, "Find app.module.ts in foo, please", C.context_tokens("x")) == ["foo"]
    assert one(spark, "version 1.2.3", C.file_tokens("x")) == []


def test_tokens_skip_long_words_and_keep_case(spark):
    got = one(spark, "Foo " + "a" * 65 + " pkg/Sub.name", T.code_tokens("x"))
    assert got == ["Foo", "foo", "pkg", "Sub", "sub", "name"]
    assert one(spark, None, T.code_tokens("x")) == []


@pytest.mark.parametrize(
    "text,gone,kept",
    [
        ('key="sk-' + "a1" * 15 + '"', "sk-a1", "[REDACTED_KEY]"),
        ("id AKIA" + "A1B2" * 4, "AKIAA1", "[REDACTED_AWS]"),
        ("Authorization: Bearer " + "abc.def-" * 4, "abc.def", "Bearer [REDACTED]"),
        ("password = hunter22", "hunter22", "password = [REDACTED]"),
        ("x deadbeef" + "0123456789abcdef" * 3 + " y", "0123456789", "[REDACTED]"),
        ("use ${MY_SECRET_KEY} here", "MY_SECRET", "[REDACTED]"),
    ],
)
def test_redaction(spark, text, gone, kept):
    out = one(spark, text, T.redact_secrets("x"))
    assert gone not in out and kept in out


def test_redaction_leaves_ordinary_text(spark):
    for text in ["a_long_ordinary_identifier_name = compute(value)", "", "d41d8cd98f00b204e9800998ecf8427e"]:
        assert one(spark, text, T.redact_secrets("x")) == text
    assert one(spark, None, T.redact_secrets("x")) == ""


def test_whitespace_and_duplicate_lines(spark):
    assert one(spark, "\n\n\na  \n\n\nb\n\n", T.compress_whitespace("x")) == "\na\n\nb\n"
    assert one(spark, "a\nb\n a\n\n\nb\nc", T.deduplicate_lines("x")) == "a\nb\n\nc"


def test_comments_and_config(spark):
    code = 'x = 1  # one\n# gone\n"""doc # kept"""\ny = 2'
    assert one(spark, code, T.strip_hash_comments("x")) == 'x = 1\n"""doc # kept"""\ny = 2'
    assert one(spark, "/** a */ x /* b */", T.jsdoc_blocks("x")) == "/** a */"
    assert one(spark, "[core]\n# c\n\nname = v\nport: 1", T.summarise_config("x")) == "[core]\nname: [configured]\nport: [configured]"


def test_small_helpers(spark):
    assert one(spark, "parseHTTPFile", T.snake_case("x")) == "parse_h_t_t_p_file"
    assert one(spark, "PDFLoader", T.camel_parts(F.col("x"))) == ["PDF", "Loader"]
    assert one(spark, "ab" * 2, T.entropy("x")) == pytest.approx(1.0)
    assert one(spark, "x" * 9, T.token_estimate("x")) == 3
    assert one(spark, "n" * 2001, F.length(T.sanitise_note("x"))) == 2001
    assert one(spark, 1536, T.human_size("x"), "long") == "1.5 KB"
    assert one(spark, 'File "a/b.py", line 7, in f', T.file_and_line("x")).asDict() == {"file": "a/b.py", "line": 7}
    assert one(spark, "handoff_2024-01-02_03-04-05.md", T.note_time("x").cast("string")) == "2024-01-02 03:04:05"
    assert [one(spark, k, T.valid_api_key("x")) for k in ("sk-" + "a" * 29, "b" * 32, "short", None)] == [True, True, False, False]
    norm = one(spark, "abc", T.hash_embedding("x"))
    assert sum(v * v for v in norm) == pytest.approx(1.0)
