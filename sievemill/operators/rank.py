"""Evidence: rank fusion, authority rules, per-file collapse, packing to a budget.

The evidence row: source, file, start_line, end_line, symbol, symbol_kind, text, score, relation, provenance.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import classify as C
from ..functions import text as T

RRF_K = 60
SCHEMA = "source string, file string, start_line int, end_line int, symbol string, symbol_kind string, text string, score double, relation string, provenance string"

# Weights of the authority rules.
WEIGHTS = {
    "exactLiteralMatch": 28,
    "symbolDefinition": 35,
    "trueDefinition": 18,
    "graphRelation": 20,
    "callerReference": 35,
    "sameLanguageImpl": 10,
    "testWhenAsked": 38,
    "docWhenImplAsked": -15,
    "docWhenTestAsked": -20,
    "generated": -20,
    "testWhenImplAsked": -12,
    "sourceWhenTestAsked": -12,
    "symbolInFilePath": 8,
    "staleDoc": -30,
    "conceptualSemantic": 15,
}
STALE = "archive|legacy|deprecated"
IMPL_WORDS = "implemented|generation|bundle|logic|validation|handler|router|service|enforced|ontology|pipeline"
IMPL_WORDS_FUSE = IMPL_WORDS + "|wired|scoring|delivery|isolation"
DOC_WORDS = "documented|explain the architecture|docs|documentation"
CALLER_WORDS = r"(?i)(^|[^a-z0-9_])(what calls|who calls|callers|used by|what breaks if)($|[^a-z0-9_])"
# Points of rules without a weight of their own.
POINTS = {"dependencyCaller": 30, "symbolInQuery": 5, "packageInit": -5, "scriptsBesideCore": -5, "wiring": 8, "internalWiring": 5, "definitionForCallers": -15, "fileHoldsQueryWord": 5}
# Fixed values of the cut of one file's rows: room for rows, rows that stay, final score that makes more room, authority that keeps more.
COLLAPSE = {"conceptual": (2, 2), "other": (4, 3), "finalBeyond": 15.0, "authorityBeyond": 10}
DEFINITION_KINDS = "function_definition|function_declaration|method|class_definition|class_declaration|struct|interface|type|enum|trait|impl"
OWN_PHRASES = ["func {}", "func ({}", "type {} struct", "type {} interface", "def {}", "class {}", "function {}", "const {}", "fn {}"]
TARGET_PHRASES = ["def {}", "class {}", "func {}", "type {} struct", "type {} interface", "function {}", "const {}", "fn {}", "struct {}", "enum {}", "trait {}"]


def rrf(lists: DataFrame, weights: Column | None = None) -> DataFrame:
    """Reciprocal rank fusion of ``lists(retriever, rank, file, symbol, start_line)``: key columns, rrf, sources.

    Weights are clipped to (0, 10]. One aggregate; ``sources`` is the true set of retrievers behind a row.
    """
    w = F.lit(1.0) if weights is None else F.when((weights > 0) & (weights <= 10), weights).otherwise(1.0)
    keys = ["file", "symbol", "start_line"]
    fused = lists.groupBy(*keys).agg(F.sum(w / (RRF_K + F.col("rank"))).alias("rrf"), F.array_sort(F.collect_set("retriever")).alias("sources"))
    return fused.orderBy(F.desc(F.round("rrf", 12)), "file", "start_line", "symbol")


def _phrases(text: Column, word: Column, phrases: list[str]) -> Column:
    tests = [F.contains(text, F.concat(*[x for p in (a, b) for x in p])) for a, b in (([F.lit(p.split("{}")[0]), word], [F.lit(p.split("{}")[1])]) for p in phrases)]
    return reduce(lambda x, y: x | y, tests)


def true_definition(query: Column) -> Column:
    """A row whose text holds a definition phrase of its own symbol (by kind) or of the query's target."""
    text, kind = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.coalesce("symbol_kind", F.lit("")))
    symbol, target = F.lower("symbol"), C.target_symbol(query)
    own = symbol.isNotNull() & kind.rlike(DEFINITION_KINDS) & ((text == "") | _phrases(text, symbol, OWN_PHRASES))
    receiver = F.contains(text, F.lit("func (")) & F.concat(F.lit(" "), F.regexp_replace(text, "[^a-z0-9_]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), target, F.lit(" ")))
    about = target.isNotNull() & (((text != "") & (_phrases(text, target, TARGET_PHRASES) | receiver)) | ((symbol == target) & kind.contains("definition") & (text != "")))
    return F.coalesce(own, F.lit(False)) | F.coalesce(about, F.lit(False))


def rules(query: Column, query_type: Column, kind: Column) -> list[tuple[Column, Column | int, str]]:
    """The rule table: when, points, reason. Repository-specific names are left out of it on purpose."""
    low, file = F.lower(query), F.col("file")
    lf, text = F.lower(file), F.lower(F.coalesce("text", F.lit("")))
    target = C.target_symbol(query)
    source, relation = F.col("source"), F.col("relation")
    wants_impl = query_type.isin("SYMBOL", "DEPENDENCY", "MIXED") | ((query_type == "CONCEPTUAL") & low.rlike(IMPL_WORDS))
    defined = true_definition(query)
    asks_callers = (query_type == "DEPENDENCY") & query.rlike(CALLER_WORDS)
    referenced = ((source == "exact") & (relation == "reference") & text.contains(target)) | (relation == "caller")
    caller = asks_callers & referenced
    flat = lambda c: F.regexp_replace(F.lower(c), "[_-]", "")
    words = F.filter(F.split(low, "[^a-z0-9]+"), lambda t: (F.length(t) >= 5) & ~t.isin("where", "which", "implemented"))
    w = WEIGHTS
    return [
        ((source == "exact") & (F.col("score") == 1.0), w["exactLiteralMatch"], "exact literal"),
        ((relation == "definition") & (source == "symbol"), w["symbolDefinition"], "symbol definition"),
        (defined, w["trueDefinition"], "true definition"),
        ((source == "graph") & relation.isin("caller", "callee"), w["graphRelation"], "graph relation"),
        ((source == "graph") & (relation == "caller") & (query_type == "DEPENDENCY"), POINTS["dependencyCaller"], "dependency graph caller"),
        (kind == "source", w["sameLanguageImpl"], "source file"),
        ((query_type == "TEST") & (kind == "test"), w["testWhenAsked"], "test when asked"),
        (F.col("symbol").isNotNull() & low.contains(F.lower("symbol")), POINTS["symbolInQuery"], "symbol in query"),
        (kind == "generated", w["generated"], "generated"),
        (lf.rlike(STALE), w["staleDoc"], "stale"),
        (wants_impl & (kind == "doc"), w["docWhenImplAsked"], "doc when impl wanted"),
        ((query_type == "TEST") & (kind == "doc"), w["docWhenTestAsked"], "doc when test asked"),
        ((query_type != "TEST") & (kind == "test"), w["testWhenImplAsked"], "test when impl wanted"),
        ((query_type == "TEST") & (kind == "source"), w["sourceWhenTestAsked"], "source when test asked"),
        ((query_type == "SYMBOL") & (flat(target) != "") & flat(file).contains(flat(target)), w["symbolInFilePath"], "symbol in file path"),
        (file.endswith("__init__.py"), POINTS["packageInit"], "__init__ re-export"),
        ((kind == "source") & file.contains("/scripts/") & F.col("_has_source"), POINTS["scriptsBesideCore"], "scripts when core exists"),
        (caller, w["callerReference"], "caller reference"),
        (caller & (text.rlike("add_command|register|newrouter|healthhandler") | text.contains(F.concat(target, F.lit(".")))), POINTS["wiring"], "wiring pattern"),
        (caller & (kind == "source") & file.contains("/internal/"), POINTS["internalWiring"], "internal wiring"),
        (asks_callers & (relation == "definition") & (source == "symbol") & defined, POINTS["definitionForCallers"], "definition for caller query"),
        ((query_type == "CONCEPTUAL") & (source == "semantic"), w["conceptualSemantic"], "conceptual semantic"),
        ((query_type == "CONCEPTUAL") & (source == "semantic") & F.exists(words, lambda t: lf.contains(t)), POINTS["fileHoldsQueryWord"], "file contains query word"),
    ]


def apply_authority(evidence: DataFrame, query: Column | str, query_type: Column | None = None, group: list[str] | None = None, *, bounded: bool = False) -> DataFrame:
    """``evidence`` with authority_score, final_score (20 * score + authority) and reasons.

    ``group`` names the columns of a question when rows of many questions are scored at once. Whether a question has source files is one
    aggregate, joined back (one row, broadcast, for a single question); the window runs per question and file. ``bounded`` evidence, that of
    one question's retrievers and their limits, is made once and looked at by a window instead.
    """
    q = F.lit(query) if isinstance(query, str) else query
    kind = C.classify_path("file")
    group = group or []
    if bounded and not group:
        base = evidence.withColumn("_has_source", F.max(kind == "source").over(W.partitionBy(F.lit(0))))
    elif group:
        seen = evidence.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]).agg(F.max(kind == "source").alias("_has_source"))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)])
        base = evidence.join(seen, same).drop(*[f"_g{i}" for i in range(len(group))])
    else:
        base = evidence.crossJoin(F.broadcast(evidence.agg(F.max(kind == "source").alias("_has_source"))))
    base = base.withColumn("_type", C.classify_query(q) if query_type is None else query_type)
    fired = [(F.coalesce(when, F.lit(False)), points, why) for when, points, why in rules(q, F.col("_type"), kind)]
    score = reduce(lambda a, b: a + b, [F.when(when, F.lit(points)).otherwise(0) for when, points, _ in fired])
    reasons = F.array_compact(F.array(*[F.when(when, F.lit(f"{points:+d} {why}")) for when, points, why in fired]))
    is_def = (F.col("source") == "symbol") & (F.col("relation") == "definition")
    first = F.min(F.when(is_def, F.col("start_line"))).over(W.partitionBy(*group, "file"))
    text = F.lower(F.coalesce("text", F.lit("")))
    earliest = is_def & (F.col("start_line") == F.col("_first")) & ~F.exists("reasons", lambda r: r.contains("true definition")) & text.rlike("def |class |func |type ")
    out = base.withColumns({"_score": score, "reasons": reasons, "_first": first})
    bonus = F.when(F.coalesce(earliest, F.lit(False)), WEIGHTS["trueDefinition"]).otherwise(0)
    reason = F.when(bonus > 0, F.array(F.lit(f"+{WEIGHTS['trueDefinition']} earliest definition in file"))).otherwise(F.array().cast("array<string>"))
    return out.select(
        *evidence.columns,
        (F.col("_score") + bonus).alias("authority_score"),
        (F.coalesce("score", F.lit(0.0)) * 20.0 + F.col("_score") + bonus).alias("final_score"),
        F.concat("reasons", reason).alias("reasons"),
    )


def _collapse(query_type: str):
    """The greedy cut of one file's rows: depends on what is kept already, so it is a fold over a bounded group."""
    strict = query_type == "CONCEPTUAL"
    room, keep = COLLAPSE["conceptual" if strict else "other"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["final_score", "_key"], ascending=[False, True], kind="stable").to_dict("records")
        kept: list[dict] = []
        for row in rows:
            start = row["start_line"]
            touches = not pd.isna(start) and any(
                not pd.isna(k["start_line"])
                and max(start, k["start_line"]) <= min(row["end_line"] if not pd.isna(row["end_line"]) else start, k["end_line"] if not pd.isna(k["end_line"]) else k["start_line"]) + 2
                for k in kept
            )
            if touches:
                rescued = row["relation"] == "definition" and row["source"] == "symbol" and not any(k["relation"] == "definition" for k in kept)
                accept = rescued or len(kept) < 2
            else:
                accept = len(kept) < room or (not strict and row["final_score"] > COLLAPSE["finalBeyond"])
            if accept:
                kept.append(row)
        final = [k for i, k in enumerate(kept) if i < keep or (not strict and k["authority_score"] > COLLAPSE["authorityBeyond"])]
        return pd.DataFrame(final, columns=pdf.columns)

    return run


def fuse(evidence: DataFrame, query: str, query_type: str, top_n: int = 10, *, bounded: bool = True) -> DataFrame:
    """Ranked evidence: authority, duplicates, per-file collapse, two documents at most where code is asked for, a definition survives.

    ``bounded`` evidence is that of one question's retrievers. Without it files are many, and only a file's own rows have to fit a task.
    """
    scored = apply_authority(evidence, query, F.lit(query_type), bounded=bounded)
    norm = F.lower(F.regexp_replace(F.replace("file", F.lit("\\"), F.lit("/")), r"^(\./)+", ""))
    key = F.concat_ws(":", norm, F.coalesce("symbol", F.lit("")), F.coalesce("start_line", F.lit(0)).cast("string"), F.coalesce("end_line", F.lit(0)).cast("string"), F.initcap("source"))
    best = [F.desc("final_score"), F.desc_nulls_last("score"), F.asc("file")]
    once = scored.withColumn("_key", key).withColumn("_n", F.row_number().over(W.partitionBy("_key").orderBy(*best))).filter("_n = 1").drop("_n").withColumn("_file", norm)
    kept = once.groupBy("_file").applyInPandas(_collapse(query_type), once.schema)
    low = query.lower()
    import re

    wants_impl = query_type in ("SYMBOL", "DEPENDENCY", "MIXED") or (query_type == "CONCEPTUAL" and re.search(IMPL_WORDS_FUSE, low) is not None)
    order = W.orderBy(F.desc("final_score"), "file", "_key")  # one question's rows: a few at most for each file
    if wants_impl and not re.search(DOC_WORDS, low):
        is_doc = (C.classify_path("file") == "doc").cast("int")
        kept = kept.withColumn("_docs", F.sum(is_doc).over(order)).filter((is_doc == 0) | (F.col("_docs") <= 2)).drop("_docs")
    is_def = F.coalesce((F.col("relation") == "definition") & (F.col("source") == "symbol"), F.lit(False))
    spare = scored.withColumns({"_key": key, "_file": norm}).filter(is_def).orderBy(F.desc("final_score"), F.asc_nulls_first("score"), F.desc("file")).limit(1)
    top = kept.orderBy(F.desc("final_score"), "file", "_key").limit(top_n)
    # the best definition, where there is one, takes the last place when none made it
    given = spare.agg((F.count("*") > 0).alias("_given"))
    flags = top.agg(F.coalesce(F.max(is_def), F.lit(False)).alias("_in"), F.count("*").alias("_rows")).crossJoin(F.broadcast(given))
    flags = flags.select((F.col("_in") | ~F.col("_given")).alias("_has"), "_rows")
    ranked = top.withColumn("_place", F.row_number().over(order)).crossJoin(F.broadcast(flags))
    spare = spare.crossJoin(F.broadcast(flags)).filter("not _has").withColumn("_place", F.lit(0))
    out = ranked.filter(F.col("_has") | (F.col("_place") < top_n)).unionByName(spare.select(*ranked.columns))
    return out.drop("_key", "_file", "_has", "_rows", "_place").orderBy(F.desc("final_score"), "file", "start_line")


def pack(ranked: DataFrame, query: str, query_type: str, budget: int = 10_000, max_files: int = 10) -> DataFrame:
    """One row: markdown, token_estimate, files. Files by best score; packing stops at the first that overflows.

    At most twice ``max_files`` rows enter, so the windows below run over a bounded set.
    """
    rows = ranked.orderBy(F.desc("final_score"), "file", "start_line").limit(2 * max_files)
    place = F.coalesce(F.col("start_line").cast("string"), F.lit("?"))
    stop = F.coalesce(F.col("end_line").cast("string"), F.lit("?"))
    loc = F.when(F.col("start_line").isNotNull(), F.concat("file", F.lit(":"), place, F.lit("-"), F.coalesce("end_line", "start_line").cast("string"))).otherwise(F.col("file"))
    number = lambda c, d: F.format_string(f"%.{d}f", F.coalesce(c, F.lit(0.0)))
    bullet = F.concat(
        F.lit("- "), loc, F.lit(" "), F.coalesce("symbol_kind", F.lit("")), F.lit(" "), F.coalesce("symbol", F.lit("")),
        F.lit(" (score:"), number(F.col("score"), 2), F.lit(" authority:"), F.col("authority_score").cast("string"), F.lit(" final:"), number(F.col("final_score"), 1), F.lit(")"),
        F.coalesce(F.concat(F.lit(" — "), F.substring("text", 1, 120)), F.lit("")), F.lit(" ["), F.coalesce("provenance", "source"), F.lit("]"),
    )
    item = F.struct(F.coalesce("start_line", F.lit(0)).alias("at"), F.concat(place, F.lit("-"), stop).alias("range"), bullet.alias("bullet"))
    files = rows.groupBy("file").agg(F.max("final_score").alias("best"), F.array_sort(F.collect_list(item)).alias("items"), F.array_sort(F.collect_set("symbol")).alias("symbols"), F.array_sort(F.collect_set("source")).alias("sources"))
    names = F.array_join("symbols", ", ")
    header = F.concat(F.lit("## "), F.col("file"), F.lit(" "), F.when(names == "", "").otherwise(F.concat(F.lit("("), names, F.lit(")"))), F.lit(" ["), F.array_join("sources", "+"), F.lit("] lines "), F.array_join(F.col("items.range"), ", "))
    body = F.concat(header, F.lit("\n"), F.array_join(F.col("items.bullet"), "\n"), F.lit("\n"))
    chunks = files.select("file", "best", body.alias("body")).orderBy(F.desc("best"), "file").limit(max_files)
    intro = f"# Evidence Pack — {query_type}\n> Query: {query}\n"
    order = W.orderBy(F.desc("best"), "file")
    start = -(-len(intro.encode()) // 4)
    counted = chunks.withColumn("n", T.token_estimate("body")).withColumn("total", F.sum("n").over(order) + start).withColumn("over", F.max((F.col("total") > budget).cast("int")).over(order)).filter("over = 0")
    listed = counted.agg(F.array_sort(F.collect_list(F.struct((-F.col("best")).alias("b"), "file", "body"))).alias("x"), F.coalesce(F.max("total"), F.lit(start)).cast("long").alias("token_estimate"))
    return listed.select(F.concat_ws("\n", F.lit(intro), F.col("x.body")).alias("markdown"), "token_estimate", F.col("x.file").alias("files"))


def sufficiency(evidence: DataFrame, query_type: str, strong_paths: str = "src/|crates/|backend/") -> DataFrame:
    """One row: STRONG, ADEQUATE or INSUFFICIENT, from what the cheap retrievers found."""
    has = lambda cond: F.coalesce(F.max(cond), F.lit(False))
    definition = (F.col("source") == "symbol") & (F.col("relation") == "definition")
    exact, test = F.col("source") == "exact", C.classify_path("file") == "test"
    graph = F.col("source") == "graph"
    flags = {
        "EXACT": (has(exact), has(exact)),
        "SYMBOL": (has(definition & F.col("file").rlike(strong_paths)), has(definition)),
        "DEPENDENCY": (has(graph), has(definition)),
        "TEST": (has(test & (F.col("source") == "test")), has(test)),
    }
    strong, adequate = flags.get(query_type, (F.lit(False), has(exact & F.lit(False))))
    return evidence.agg(F.when(strong, "STRONG").when(adequate, "ADEQUATE").otherwise("INSUFFICIENT").alias("sufficiency"))


def overlapping(a: DataFrame, b: DataFrame, slack: int = 2, width: int = 256) -> DataFrame:
    """Pairs of rows of one file whose line ranges come within ``slack`` lines: an interval join on bins of ``width`` lines.

    Each range is put in every bin it touches, the join is on (file, bin), and a pair counts in the first bin it shares.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.floor(e / width)))
    left = a.select("file", F.col("start_line").alias("s1"), F.coalesce("end_line", "start_line").alias("e1"), F.col("id").alias("id1")).withColumn("bin", bins(F.col("s1"), F.col("e1") + slack))
    right = b.select("file", F.col("start_line").alias("s2"), F.coalesce("end_line", "start_line").alias("e2"), F.col("id").alias("id2")).withColumn("bin", bins(F.col("s2"), F.col("e2") + slack))
    hit = (F.greatest("s1", "s2") <= F.least("e1", "e2") + slack) & (F.col("bin") == F.floor(F.greatest("s1", "s2") / width))
    return left.join(right, ["file", "bin"]).filter(hit & (F.col("id1") < F.col("id2"))).select("file", "id1", "id2")
