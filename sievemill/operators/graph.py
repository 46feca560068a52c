"""Symbols and call graph: lookups, edge resolution, incremental maintenance, reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.classify import basename

PER_SYMBOL = 100


def symbol_definitions(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.filter((F.col("name") == name) | (F.col("qualified_name") == name)).orderBy("file", "start_line")


def symbol_by_id(symbols: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """Symbols of the given ids: a few as literals, or a table ``(id)`` by a join."""
    if isinstance(ids, DataFrame):
        return symbols.join(ids.select("id").distinct(), "id", "left_semi")
    return symbols.filter(F.col("id").isin(list(ids)))


def symbol_prefix(symbols: DataFrame, prefix: str, limit: int = 100) -> DataFrame:
    """Case-insensitive LIKE in which the prefix's own wildcards stay wildcards."""
    like = prefix + "%"
    return symbols.filter(F.col("name").ilike(like) | F.col("qualified_name").ilike(like)).orderBy("name", "file", "start_line").limit(limit)


def references(refs: DataFrame, name: str, limit: int = 100) -> DataFrame:
    return refs.filter(F.col("name") == name).orderBy("file", "line").limit(limit)


def resolve_edges(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call edges of ``refs(name, file, line, parent_symbol, kind)``: resolved, probable or unresolved.

    One symbol of the name resolves; of several, exactly one in the caller's file is probable; else a qualified name
    resolves (of several the smallest file, line and id); else nothing does. The symbol side is aggregated to one row a
    name before it is joined, so a common name costs no more than its references.
    """
    calls = refs.filter("kind = 'call'").select(F.col("parent_symbol").alias("caller_symbol_id"), F.col("name").alias("callee_name"), "file", "line")
    by_name = symbols.groupBy(F.col("name").alias("callee_name")).agg(F.count("*").alias("n"), F.min("id").alias("only"))
    here = symbols.groupBy(F.col("name").alias("callee_name"), "file").agg(F.count("*").alias("n_here"), F.min("id").alias("mine"))
    qualified = symbols.groupBy(F.col("qualified_name").alias("callee_name")).agg(F.min(F.struct("file", "start_line", "id"))["id"].alias("full"))
    joined = calls.join(by_name, "callee_name", "left").join(here, ["callee_name", "file"], "left").join(qualified, "callee_name", "left")
    one, near = F.col("n") == 1, (F.col("n") > 1) & (F.col("n_here") == 1)
    return joined.select(
        "caller_symbol_id",
        "callee_name",
        F.when(one, F.col("only")).when(near, F.col("mine")).otherwise(F.col("full")).alias("resolved_symbol_id"),
        F.when(one, "resolved").when(near, "probable").when(F.col("full").isNotNull(), "resolved").otherwise("unresolved").alias("confidence"),
        "file",
        "line",
    )


def callers(edges: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Edges that resolve to a definition of ``name``, 100 a definition; only if there are none, those of its name."""
    ids = symbols.filter((F.col("name") == name) | (F.col("qualified_name") == name)).select(F.col("id").alias("resolved_symbol_id")).distinct()
    order = W.partitionBy("resolved_symbol_id").orderBy("file", "line", "caller_symbol_id")
    sure = edges.join(ids, "resolved_symbol_id", "left_semi").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= PER_SYMBOL).drop("n").withColumn("tier", F.lit(0))
    loose = edges.filter(F.col("callee_name") == name).withColumn("tier", F.lit(1))
    both = sure.unionByName(loose)
    best = both.agg(F.min("tier").alias("best"))
    return both.crossJoin(F.broadcast(best)).filter("tier = best").drop("tier", "best").dropDuplicates(["file", "line", "caller_symbol_id", "resolved_symbol_id"])


def callees(edges: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    ids = symbols.filter((F.col("name") == name) | (F.col("qualified_name") == name)).select(F.col("id").alias("caller_symbol_id")).distinct()
    return edges.join(ids, "caller_symbol_id", "left_semi")


def related_tests(symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Symbols like the query in files like a test; a query of one character must equal the name."""
    hit = (F.col("name") == query) | (F.col("qualified_name") == query) if len(query) <= 1 else F.col("name").ilike(f"%{query}%") | F.col("qualified_name").ilike(f"%{query}%")
    place = F.col("file").ilike("%test%") | F.col("file").ilike("%spec%")
    return symbols.filter(hit & place).orderBy("file", "start_line", "id").limit(limit)


#: Test file names by convention; {} is the lower-case or snake-case symbol.
TEST_NAMES = ["test_{}.py", "{}_test.py", "{}_test.go", "{}.spec.ts", "{}.test.ts", "{}.test.js", "{}_test.rs"]


def snake(name: str) -> str:
    """``functions.text.snake_case`` of one name on the driver."""
    return "".join(("_" if c.isupper() and i else "") + c.lower() for i, c in enumerate(name))


def test_files(files: DataFrame, symbol: str) -> DataFrame:
    names = sorted({n.format(v) for n in TEST_NAMES for v in (symbol.lower(), snake(symbol))})
    return files.filter(F.lower(basename("path")).isin(names)).orderBy("path")


def inline_tests(symbols: DataFrame, name: str) -> DataFrame:
    """Definitions of ``name`` whose file also holds test symbols."""
    tests = symbols.filter((F.lower("name").isin("test", "tests")) | F.lower("name").startswith("test_")).select("file").distinct()
    return symbols.filter(F.col("name") == name).join(tests, "file", "left_semi").orderBy("file", "start_line")


def affected_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names, plain and qualified, of symbols that only one version of the changed files has: calls by them may resolve anew."""
    keys = [c for c in ("name", "qualified_name", "id") if c in old.columns]
    a, b = old.select(*keys).distinct(), new.select(*keys).distinct()
    differ = a.join(b, keys, "left_anti").union(b.join(a, keys, "left_anti"))
    return differ.select(F.explode(F.array(*[c for c in keys if c != "id"])).alias("name")).distinct()


def maintain_edges(edges: DataFrame, refs: DataFrame, symbols: DataFrame, changed: DataFrame, names: DataFrame) -> DataFrame:
    """Edges after a change: those of changed files and of affected names are made anew, the rest stay.

    ``refs`` and ``symbols`` are the new tables; ``changed(file)`` and ``names(name)`` are the small sides.
    """
    files, affected = changed.select("file").distinct(), names.select(F.col("name").alias("callee_name")).distinct()
    kept = edges.join(files, "file", "left_anti").join(affected, "callee_name", "left_anti")
    touched = refs.join(files, "file", "left_semi").unionByName(refs.join(files, "file", "left_anti").join(names.select("name").distinct(), "name", "left_semi"))
    return kept.unionByName(resolve_edges(touched, symbols))


def call_path(edges: DataFrame, source: str, target: str, checkpoint, max_depth: int = 8) -> DataFrame:
    """The shortest chain of resolved calls, breadth first: ``(depth, path)``; no row where there is none.

    Each round joins the frontier to the edges once and keeps a node's first visit; ``checkpoint(df, name)`` cuts lineage.
    """
    e = edges.filter("resolved_symbol_id is not null").select(F.col("caller_symbol_id").alias("a"), F.col("resolved_symbol_id").alias("b")).distinct()
    spark = edges.sparkSession
    front = spark.createDataFrame([(source, [source])], "node string, path array<string>")
    seen = front.select("node")
    for depth in range(max_depth + 1):
        front = checkpoint(front, f"front-{depth}")
        hit = front.filter(F.col("node") == target)
        if not hit.isEmpty():
            return hit.select(F.lit(depth).alias("depth"), "path").orderBy("path").limit(1)
        if front.isEmpty():
            break
        seen = checkpoint(seen.union(front.select("node")).distinct(), f"seen-{depth}")
        step = front.join(e, front["node"] == e["a"]).select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        front = step.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti")
    return spark.createDataFrame([], "depth int, path array<string>")
