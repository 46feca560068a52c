"""Questions to plans to packs: search, symbol, dependency, tests, status over index tables."""

from __future__ import annotations

import os
from collections import OrderedDict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import classify as C
from ..functions import registry
from ..functions import text as T
from ..operators import graph, lexical, rank, vectors

#: Defaults, fixed values.
BUDGET, MAX_RESULTS = 10_000, 10
#: Query vectors that are kept, the least recently used one going first; fixed value.
QUERY_VECTORS = 128
TAKE_CALLERS, TAKE_CALLEES, TAKE_DEFINITIONS, TAKE_CHUNKS = 50, 20, 5, 25


@dataclass
class Plan:
    query: str
    query_type: str
    identifiers: list[str] = field(default_factory=list)
    target: str | None = None
    exact: list[tuple[str, str]] = field(default_factory=list)
    symbols: list[str] = field(default_factory=list)
    semantic: list[str] = field(default_factory=list)
    graph: list[tuple[str, str]] = field(default_factory=list)
    tests: list[str] = field(default_factory=list)


def make_plan(spark: SparkSession, query: str) -> Plan:
    """Which retrievers run with what: a branch that is not needed is never part of the job."""
    q = F.lit(query)
    row = spark.range(1).select(C.classify_query(q).alias("t"), C.extract_identifiers(q).alias("ids"), C.target_symbol(q).alias("target"), C.file_tokens(q).alias("files"), C.context_tokens(q).alias("ctx")).first()
    p = Plan(query, row.t, list(row.ids), row.target)
    files = [("path" if "/" in f else "filename", f) for f in row.files]
    context = [("literal", c) for c in row.ctx]
    first = p.identifiers[:1] or query.split()[-1:]
    if p.query_type == "EXACT":
        bare = query.strip().strip("\"'")
        p.exact = files + context if files else [("path" if "/" in bare else "filename" if "." in bare else "literal", bare)]
    elif p.query_type == "SYMBOL":
        p.symbols, p.exact = p.identifiers, [("literal", i) for i in p.identifiers[:1]]
    elif p.query_type == "DEPENDENCY":
        p.symbols, p.exact = first, [("literal", i) for i in first]
        p.graph = [(i, d) for i in first for d in (["callers", "callees"] if "callees" in query.lower() or "what does" in query.lower() else ["callers"])]
    elif p.query_type == "TEST":
        p.semantic, p.tests = [query], p.identifiers[:2]
        p.exact = [("filename", n.format(v)) for i in p.tests for v in dict.fromkeys((i.lower(), graph.snake(i))) for n in graph.TEST_NAMES[:5]]
    elif p.query_type == "CONCEPTUAL":
        p.semantic = [query]
    else:
        p.semantic, p.symbols = [query], p.identifiers
        p.exact = [("literal", i) for i in p.identifiers[:3]] + files + context
    return p


def direction(text: str | None) -> str:
    """Anything that is not callees means callers."""
    return "callees" if (text or "").strip().lower() in ("callees", "callee") else "callers"


@dataclass
class Index:
    """The tables a search reads: files(path, content), symbols, edges, chunks, postings of the chunks, and optionally vectors with an embedder."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    chunks: DataFrame
    vectors: DataFrame | None = None
    bm25: lexical.Bm25 | None = None
    embedder: str = "hash"
    _known: OrderedDict = field(default_factory=OrderedDict, repr=False)

    def embed(self, text: str) -> list[float]:
        """The question's vector by the named embedder; the last ``QUERY_VECTORS`` are kept."""
        key = (self.embedder, text)
        if key not in self._known:
            rows = self.files.sparkSession.createDataFrame([(text,)], "t string")
            self._known[key] = list(rows.select(registry.EMBEDDERS[self.embedder](F.col("t")).alias("v")).first().v)
        self._known.move_to_end(key)
        while len(self._known) > QUERY_VECTORS:
            self._known.popitem(last=False)
        return self._known[key]


_COLUMNS = [c.split()[0] for c in rank.SCHEMA.split(", ")]


def _evidence(df: DataFrame, **values) -> DataFrame:
    cols = []
    for spec in rank.SCHEMA.split(", "):
        name, kind = spec.split()
        value = values.get(name)
        cols.append((F.lit(None) if value is None else F.col(value[1:]) if isinstance(value, str) and value.startswith("$") else F.lit(value)).cast(kind).alias(name))
    return df.select(*cols)


def _exact(ix: Index, kind: str, value: str) -> DataFrame:
    if kind in ("filename", "path"):
        hit = lexical.path_lookup(ix.files, value).select("path", F.concat(F.lit("File exists: "), "path").alias("t"))
        return _evidence(hit, source="exact", file="$path", start_line=1, end_line=1, text="$t", score=1.0, relation="reference", provenance="exact:path")
    hits = lexical.exact_search(ix.files.select(F.col("path").alias("doc_id"), F.col("content").alias("text")), value)
    return _evidence(hits, source="exact", file="$doc_id", start_line="$line", end_line="$line", text="$text", score=1.0, relation="reference", provenance="exact:text")


def _definitions(ix: Index, name: str, limit: int = TAKE_DEFINITIONS) -> DataFrame:
    found = graph.symbol_definitions(ix.symbols, name).limit(limit)
    text = ix.chunks.select(F.col("parent_symbol").alias("id"), F.substring("text", 1, 400).alias("body"))
    return _evidence(found.join(text, "id", "left"), source="symbol", file="$file", start_line="$start_line", end_line="$end_line", symbol="$name", symbol_kind="$kind", text="$body", score=1.0, relation="definition", provenance="symbol")


def _graph(ix: Index, name: str, way: str) -> DataFrame:
    if way == "callers":
        found, other, relation, take = graph.callers(ix.edges, ix.symbols, name), "caller_symbol_id", "caller", TAKE_CALLERS
    else:
        found, other, relation, take = graph.callees(ix.edges, ix.symbols, name), "resolved_symbol_id", "callee", TAKE_CALLEES
    found = found.orderBy("file", "line", other).limit(take).withColumnRenamed("file", "at_file")
    ends = ix.symbols.select(F.col("id").alias(other), F.col("name").alias("end_name"), F.col("kind").alias("end_kind"))
    lines = ix.files.select(F.col("path").alias("at_file"), F.col("content").alias("_c"))
    body = F.substring(F.get(F.split("_c", "\n"), F.col("line") - 1), 1, 400)
    joined = found.join(ends, other, "left").join(lines, "at_file", "left").withColumn("body", body).withColumn("score_", F.when(F.col("confidence") == "resolved", 0.9).otherwise(0.5))
    return _evidence(joined, source="graph", file="$at_file", start_line="$line", end_line="$line", symbol="$end_name", symbol_kind="$end_kind", text="$body", score="$score_", relation=relation, provenance="graph")


def _tests(ix: Index, name: str) -> DataFrame:
    """Test symbols; if there are none, test files by convention; if none, definitions beside inline tests."""
    a = _evidence(graph.related_tests(ix.symbols, name), source="test", file="$file", start_line="$start_line", end_line="$end_line", symbol="$name", symbol_kind="$kind", score=0.9, relation="test", provenance="test:symbol").withColumn("_tier", F.lit(0))
    b = _evidence(graph.test_files(ix.files, name), source="test", file="$path", start_line=1, end_line=1, score=0.8, relation="test", provenance="test:name").withColumn("_tier", F.lit(1))
    c = _evidence(graph.inline_tests(ix.symbols, name), source="test", file="$file", start_line="$start_line", end_line="$end_line", symbol="$name", symbol_kind="$kind", score=0.7, relation="test", provenance="test:inline").withColumn("_tier", F.lit(2))
    every = a.unionByName(b).unionByName(c)
    return every.crossJoin(F.broadcast(every.agg(F.min("_tier").alias("_best")))).filter("_tier = _best").drop("_tier", "_best")


def semantic_weight() -> float:
    """The semantic retriever's weight in conceptual questions; an override counts only in (0, 10]."""
    try:
        w = float(os.environ.get("SIEVEMILL_SEMANTIC_WEIGHT", "2"))
    except ValueError:
        return 2.0
    return w if 0 < w <= 10 else 2.0


def _chunk_texts(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.concat_ws(" ", "text", "file", "qualified_name").alias("text"))


def _fused(ix: Index, query: str, query_type: str) -> DataFrame:
    """BM25 and vectors over chunks, fused by reciprocal rank."""
    found = lexical.search_bm25(ix.bm25, query, TAKE_CHUNKS) if ix.bm25 else lexical.bm25_search(_chunk_texts(ix.chunks), query, TAKE_CHUNKS, key="chunk_id")
    bm25 = found.withColumn("retriever", F.lit("bm25"))
    ranked = bm25
    if ix.vectors is not None:
        near = vectors.knn(ix.vectors, ix.embed(query), TAKE_CHUNKS, key="chunk_id").withColumn("retriever", F.lit("semantic"))
        ranked = bm25.unionByName(near)
    place = F.row_number().over(W.partitionBy("retriever").orderBy(F.desc("score"), "chunk_id"))
    lists = ranked.withColumn("rank", place).join(ix.chunks.select("chunk_id", "file", F.col("qualified_name").alias("symbol"), "start_line", "end_line", F.substring("text", 1, 600).alias("body")), "chunk_id")
    weight = F.when((F.lit(query_type) == "CONCEPTUAL") & (F.col("retriever") == "semantic"), semantic_weight()).otherwise(1.0)
    fused = rank.rrf(lists, weight)
    rows = fused.join(lists.select("file", "symbol", "start_line", "end_line", "body").dropDuplicates(["file", "symbol", "start_line"]), ["file", "symbol", "start_line"])
    rows = rows.withColumn("kind_", F.when(F.array_contains("sources", "semantic"), "semantic").otherwise("bm25")).withColumn("prov", F.array_join("sources", "+"))
    return _evidence(rows, source="$kind_", file="$file", start_line="$start_line", end_line="$end_line", symbol="$symbol", text="$body", score="$rrf", relation="reference", provenance="$prov")


def retrieve(ix: Index, p: Plan) -> DataFrame:
    """All evidence of a plan. Chunk retrieval is left out where cheap evidence suffices; that check is one small job."""
    parts = [_exact(ix, k, v) for k, v in p.exact] + [_definitions(ix, s) for s in p.symbols] + [_graph(ix, s, d) for s, d in p.graph] + [_tests(ix, s) for s in p.tests]
    cheap = reduce(DataFrame.unionByName, parts) if parts else ix.files.sparkSession.createDataFrame([], rank.SCHEMA)
    if p.query_type == "EXACT":
        return cheap
    if p.query_type in ("SYMBOL", "DEPENDENCY", "TEST"):
        level = rank.sufficiency(cheap, p.query_type).first().sufficiency
        if level == "STRONG" or (level == "ADEQUATE" and p.query_type != "TEST"):
            return cheap
    return reduce(DataFrame.unionByName, [_plugged(ix, name, p.query) for name in registry.RETRIEVERS], cheap.unionByName(_fused(ix, p.query, p.query_type)))


def _plugged(ix: Index, name: str, query: str) -> DataFrame:
    """Evidence of a registered retriever: ``(rank, file, score)`` of the index's files."""
    hits = registry.RETRIEVERS[name](ix.files, query, TAKE_CHUNKS)
    return _evidence(hits, source=name, file="$file", start_line=1, end_line=1, score="$score", relation="reference", provenance=f"plugin:{name}")


def search(ix: Index, query: str, *, budget: int = BUDGET, max_results: int = MAX_RESULTS) -> DataFrame:
    """Ranked evidence for a question."""
    p = make_plan(ix.files.sparkSession, query)
    return rank.fuse(retrieve(ix, p), query, p.query_type, max_results)


def search_pack(ix: Index, query: str, *, budget: int = BUDGET, max_results: int = MAX_RESULTS) -> DataFrame:
    """One row: the evidence as markdown within a token budget."""
    p = make_plan(ix.files.sparkSession, query)
    return rank.pack(rank.fuse(retrieve(ix, p), query, p.query_type, max_results), query, p.query_type, budget, max_results)


def symbol(ix: Index, name: str, **options) -> DataFrame:
    return search(ix, name, **options)


def dependency(ix: Index, name: str, way: str | None = None, *, max_results: int = MAX_RESULTS) -> DataFrame:
    """Callers or callees of a symbol; its definitions where there are none."""
    found = _graph(ix, name, direction(way)).withColumn("_tier", F.lit(0))
    spare = _definitions(ix, name, 2).withColumn("_tier", F.lit(1))
    both = found.unionByName(spare)
    rows = both.crossJoin(F.broadcast(both.agg(F.min("_tier").alias("_best")))).filter("_tier = _best").drop("_tier", "_best")
    return rank.fuse(rows, f"what calls {name}" if direction(way) == "callers" else f"callees of {name}", "DEPENDENCY", max_results)


def tests(ix: Index, name: str, **options) -> DataFrame:
    return search(ix, f"What tests cover {name}?", **options)


def status(ix: Index) -> DataFrame:
    """One row of table sizes."""
    from ..operators.prep import status_report

    given = {"files": ix.files, "symbols": ix.symbols, "edges": ix.edges, "chunks": ix.chunks}
    return status_report(**given, **({"vectors": ix.vectors} if ix.vectors is not None else {}))


TABLES = ("files", "symbols", "edges", "chunks", "vectors")


def store_index(ix: Index, path: str) -> Index:
    """Writes every table and the postings below ``path``, and returns the index over what was written: questions then parse and tokenize nothing."""
    for name in TABLES:
        if (table := getattr(ix, name)) is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    stored = load_index(ix.files.sparkSession, path, vectors=ix.vectors is not None, bm25=False)
    stored.embedder = ix.embedder
    stored.bm25 = lexical.store_bm25(lexical.build_bm25(_chunk_texts(stored.chunks), key="chunk_id"), f"{path}/bm25")
    return stored


def load_index(spark: SparkSession, path: str, *, vectors: bool = True, bm25: bool = True) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(read("files"), read("symbols"), read("edges"), read("chunks"), read("vectors") if vectors else None, lexical.load_bm25(spark, f"{path}/bm25", "chunk_id") if bm25 else None)


def build_index(files: DataFrame, *, embed: bool = True, embedder: str = "hash") -> Index:
    """Index tables of ``files(path, language, content)`` as plans; ``store_index`` writes them to be used more than once."""
    from ..sources import extract

    parsed = extract.parse_files(files)
    t = extract.tables(parsed)
    chunks = extract.chunks(t["symbols"], files)
    vecs = chunks.select("chunk_id", registry.EMBEDDERS[embedder](F.col("text")).alias("embedding")) if embed else None
    return Index(files, t["symbols"], graph.resolve_edges(t["refs"], t["symbols"]), chunks, vecs, embedder=embedder)
