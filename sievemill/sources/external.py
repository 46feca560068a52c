"""Results of an external code index, given as text, to evidence rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed formats of the two kinds of answer.
HIT = r"^\[([0-9]+)\] (\S+) \"([^\"]*)\" at (.+?):([0-9]+)(?:-([0-9]+))?(?: \(score: ([0-9.]+)\))?"
CALL = r"^\s*(?:->|<-|[-*])?\s*([A-Za-z_][A-Za-z0-9_.:]*)\s+\(([^:()]+):([0-9]+)\)\s*(\[unresolved\])?"
CODE_CHARS = 800


def parse_hits(answers: DataFrame) -> DataFrame:
    """``answers(id, text)`` of search hits to rows; the fenced code behind a hit is its text, 800 characters at most."""
    blocks = answers.select("id", F.explode(F.split("text", r"(?m)^(?=\[[0-9]+\] )")).alias("b")).filter(F.col("b").rlike(HIT))
    part = lambda i: F.nullif(F.regexp_extract("b", HIT, i), F.lit(""))
    code = F.nullif(F.regexp_extract("b", r"(?s)```[A-Za-z0-9]*\n(.*?)\n?```", 1), F.lit(""))
    return blocks.select(
        "id", part(1).cast("int").alias("rank"), part(2).alias("symbol_kind"), part(3).alias("symbol"), part(4).alias("file"), part(5).cast("int").alias("start_line"),
        F.coalesce(part(6), part(5)).cast("int").alias("end_line"), part(7).cast("double").alias("score"), F.substring(code, 1, CODE_CHARS).alias("text"),
    )


def parse_calls(answers: DataFrame) -> DataFrame:
    """``answers(id, text)`` of call-graph lines to rows: 0.9 for resolved calls, 0.5 for unresolved ones."""
    lines = answers.select("id", F.explode(F.split("text", "\n")).alias("b")).filter(F.col("b").rlike(CALL))
    part = lambda i: F.regexp_extract("b", CALL, i)
    return lines.select("id", part(1).alias("symbol"), part(2).alias("file"), part(3).cast("int").alias("line"), F.when(part(4) == "", 0.9).otherwise(0.5).alias("score"))
