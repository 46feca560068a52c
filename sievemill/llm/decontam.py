"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` consecutive words of a benchmark text; a text of fewer words, but not
none, is one pattern. For each pattern length a shift table over blocks of words tells how far the window's
end may jump; a shift of zero leads to the bucket of patterns that end in that block, where a pattern is selected by the hash
of its whole window, and the bytes of its words are compared before an occurrence counts. Many cursors, each over a stretch of a
document, move through a block of text at once. The automaton is a handful of arrays over one buffer of the benchmark's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesops import Words, mix, sums_by, text_blocks
from .shared import ROW, SRC, Scratch, identified, set_aside, split_rows

#: Bytes of benchmark text that one automaton holds. A larger benchmark is searched in several passes.
MAX_BENCHMARK_BYTES = 8 << 20
#: Window ends that one cursor covers.
STRETCH = 128
_W = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _block_hash(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out += h[at - j] * _W[j]
    return mix(out)


def _window_hash(h: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros(len(first), np.uint64)
    for j in range(m):
        out = out * _W[0] + h[first + j]
    return mix(out)


def _plain(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The block's words parted by one blank, and where each begins and ends in that."""
    keep = np.zeros(len(words.low) + 1, np.int8)
    keep[words.starts] += 1
    keep[words.ends] -= 1
    sizes = words.ends - words.starts
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    out[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = words.low[np.cumsum(keep[:-1]) > 0]
    return out.tobytes(), ends - sizes, ends


class _Length:
    """Shift table and suffix buckets of the patterns of one length: ``first`` words in the benchmark's stream, ``item`` each."""

    def __init__(self, m: int, first: np.ndarray, item: np.ndarray, hashes: np.ndarray, text: bytes, begins: np.ndarray, ends: np.ndarray):
        self.m, self.size = m, min(3, m)
        self.bits = int(np.clip(np.ceil(np.log2(len(first) * m * 8 + 2)), 12, 24))
        self.shift = np.full(1 << self.bits, m - self.size + 1, np.uint8 if m < 250 else np.int64)
        for end in range(self.size - 1, m):
            key = _block_hash(hashes, first + end, self.size) >> np.uint64(64 - self.bits)
            np.minimum.at(self.shift, key, self.shift.dtype.type(m - 1 - end))
        suffix, whole = _block_hash(hashes, first + m - 1, self.size), _window_hash(hashes, first, m)
        order = np.lexsort((item, whole, suffix))
        suffix, whole, first, item = suffix[order], whole[order], first[order], item[order]
        same = np.append(False, (suffix[1:] == suffix[:-1]) & (whole[1:] == whole[:-1])) if len(first) else np.empty(0, bool)
        for i in np.flatnonzero(same).tolist():  # equal hashes make one pattern only where the bytes are equal
            x, y = (text[begins[f] : ends[f + m - 1]] for f in (first[i - 1], first[i]))
            same[i] = x == y
        lead = np.flatnonzero(~same)
        self.whole, self.owner_at, self.owners = whole[lead], np.append(lead, len(first)).astype(np.uint32), item.astype(np.uint32)
        self.begin, self.end = begins[first[lead]].astype(np.uint32), ends[first[lead] + m - 1].astype(np.uint32)
        self.suffix, at = np.unique(suffix[lead], return_index=True)
        self.bucket = np.append(at, len(lead)).astype(np.uint32)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def search(self, words: Words, text: bytes, plain) -> Iterator[tuple[int, int]]:
        """``(index of the last word, pattern)`` of each occurrence; ``plain()`` gives the block's words as bytes."""
        m, h, bounds = self.m, words.hashes, words.bounds
        counts = np.diff(bounds) - m + 1
        docs = np.flatnonzero(counts > 0)
        if not len(docs):
            return
        pieces = -(-counts[docs] // STRETCH)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(bounds[:-1][docs] + m - 1, pieces)
        pos = begin + nth * STRETCH
        stop = np.minimum(pos + STRETCH, np.repeat(bounds[1:][docs], pieces))
        found = []
        while len(pos):
            key = _block_hash(h, pos, self.size)
            jump = self.shift[key >> np.uint64(64 - self.bits)].astype(np.int64)
            zero = jump == 0
            if zero.any():
                k, p = key[zero], pos[zero]
                at = np.minimum(np.searchsorted(self.suffix, k), len(self.suffix) - 1)
                same = self.suffix[at] == k
                if same.any():
                    found.append(np.stack([p[same], at[same]]))
            pos = pos + np.maximum(jump, 1)
            on = pos < stop
            pos, stop = pos[on], stop[on]
        if not found:
            return
        p, at = np.concatenate(found, 1)
        whole = _window_hash(h, p - m + 1, m)
        lo, end = self.bucket[at].astype(np.int64), self.bucket[at + 1].astype(np.int64)
        hi = end.copy()
        while (lo < hi).any():  # binary search within each bucket
            mid = np.minimum((lo + hi) // 2, len(self.whole) - 1)
            less = (lo < hi) & (self.whole[mid] < whole)
            lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
        hit = (lo < end) & (self.whole[np.minimum(lo, len(self.whole) - 1)] == whole)
        if not hit.any():
            return
        raw, begins, ends = plain()
        for last, i, stop_at, w in zip(p[hit].tolist(), lo[hit].tolist(), end[hit].tolist(), whole[hit].tolist(), strict=True):
            mine = raw[begins[last - m + 1] : ends[last]]
            while i < stop_at and int(self.whole[i]) == w:
                if text[self.begin[i] : self.end[i]] == mine:  # equal bytes, not just equal hashes
                    yield last, i
                    break
                i += 1


class WuManber:
    """Searches whole documents for every window of the items ``(id or None, text)``."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = 10):
        parts, hashes, begins, ends, counts, base = [], [], [], [], [], 0
        for _, _, buf, offsets in text_blocks(pa.array([t for _, t in items], pa.large_string())):
            w = Words(buf, offsets)
            raw, b, e = _plain(w)
            parts.append(raw)
            hashes.append(w.hashes)
            begins.append(b + base)
            ends.append(e + base)
            counts.append(np.diff(w.bounds))
            base += len(raw)
        join = lambda x, kind: np.concatenate([*x, np.empty(0, kind)])
        self.text = b"".join(parts)
        h, begin, end, n = join(hashes, np.uint64), join(begins, np.int64), join(ends, np.int64), join(counts, np.int64).astype(np.int64)
        first_of = np.cumsum(n) - n
        m, self.lengths = np.minimum(n, window), []
        for size in np.unique(m[m > 0]).tolist():
            mine = np.flatnonzero(m == size)
            windows = n[mine] - size + 1
            item = np.repeat(mine, windows)
            first = np.repeat(first_of[mine], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            self.lengths.append(_Length(size, first, item, h, self.text, begin, end))
        self.ids = [None if i is None else str(i) for i, _ in items]

    def nbytes(self) -> int:
        """Bytes of the arrays and the buffer."""
        return len(self.text) + sum(x.nbytes() for x in self.lengths)

    def scan(self, column: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[set[str]], np.ndarray]]:
        """For each block: words and hit words of its documents, ids of items found, and hit ranges."""
        for lo, hi, buf, offsets in text_blocks(column):
            w = Words(buf, offsets)
            delta = np.zeros(len(w.starts) + 1, np.int64)
            items: list[set[str]] = [set() for _ in range(hi - lo)]
            made: list = []

            def plain(w=w, made=made):
                if not made:
                    made.append(_plain(w))
                return made[0]

            for length in self.lengths:
                got = list(length.search(w, self.text, plain))
                if not got:
                    continue
                ends = np.array([g[0] for g in got])
                np.add.at(delta, ends - length.m + 1, 1)
                np.add.at(delta, ends + 1, -1)
                docs = np.searchsorted(w.bounds, ends, "right") - 1
                for d, p in {(int(d), g[1]) for d, g in zip(docs, got, strict=True)}:
                    mine = length.owners[length.owner_at[p] : length.owner_at[p + 1]].tolist()
                    items[d].update(self.ids[i] for i in mine if self.ids[i] is not None)
            hit = np.cumsum(delta[:-1]) > 0
            yield np.diff(w.bounds), sums_by(w.bounds, hit), items, hit, w.bounds


SCHEMA = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("hit_ranges", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def _parts(benchmark: DataFrame, id_col: str, text_col: str, max_bytes: int):
    """How many lists of at most about ``max_bytes`` of text the benchmark makes, and a function that reads one."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // max_bytes))

    def read(b: int) -> list[tuple[object, str]]:
        block = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == b)
        return [(r.i, r.t) for r in block.toLocalIterator()]

    return parts, read


#: A word of the text as it is: letters of both cases, digits and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    max_benchmark_bytes: int = MAX_BENCHMARK_BYTES,
) -> DataFrame:
    """Every column of ``docs`` plus a struct ``contamination`` (n_words, n_hit, n_items, item_ids, hit_ranges).

    One row comes back for each input row, so repeated rows and repeated ids are kept apart. Null texts have
    no words. Items without words match nothing; items that share an id count once; items with a null id
    hit words but are not listed. An empty benchmark hits nothing. ``hit_ranges`` are ``[first, end)`` word
    positions. Extra columns pass through untouched, whatever their names (``contamination`` is replaced).

    A benchmark of up to ``max_benchmark_bytes`` is one narrow pass over the documents; nothing is shuffled. A larger one is
    searched in parts, one after the other: each pass writes what it hits, and its automaton is let go before the next is built.
    Hits are then joined to the rows that have any; the other rows' texts are not shuffled.
    """
    docs = docs.drop("contamination")
    parts, read = _parts(benchmark, item_id, item_text, max_benchmark_bytes)
    context = docs.sparkSession.sparkContext
    if parts == 1:
        automaton = context.broadcast(WuManber(read(0), window))
        schema = T.StructType([*docs.schema.fields, T.StructField("contamination", SCHEMA)])
        return docs.mapInArrow(_pass(automaton, docs.columns.index(text_col)), schema)
    scratch = Scratch(docs.sparkSession, "decontam")
    safe, restore = set_aside(docs)
    rows, hits = identified(safe, scratch), None
    for b in range(parts):
        automaton = context.broadcast(WuManber(read(b), window))
        found = rows.select(SRC, ROW, text_col).mapInArrow(_hits(automaton), f"{SRC} long, {ROW} long, ids array<string>, ranges array<array<long>>")
        found = scratch.put(found, f"hits-{b}")
        automaton.unpersist(blocking=False)
        hits = found if hits is None else hits.union(found)
    merged = hits.groupBy(SRC, ROW).agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("ranges")).alias("ranges"))
    merged = scratch.put(merged.mapInArrow(_merge, f"{SRC} long, {ROW} long, _sm_ids array<string>, _sm_ranges array<array<long>>"), "hits")
    touched, clean = split_rows(rows, merged.select(SRC, ROW), scratch, "hit-bits")

    def result(d: DataFrame, ids, ranges) -> DataFrame:
        n_hit = F.aggregate(ranges, F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
        n_words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
        found = F.struct(n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), ranges.alias("hit_ranges"))
        return restore(d.withColumn("contamination", found).select(*safe.columns, "contamination"))

    none = F.array().cast("array<string>"), F.array().cast("array<array<long>>")
    return result(touched.join(merged, [SRC, ROW]), F.col("_sm_ids"), F.col("_sm_ranges")).unionByName(result(clean, *none))


def _ranges(hit: np.ndarray, bounds: np.ndarray) -> list[list[list[int]]]:
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        x = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
        out.append(np.stack([np.flatnonzero(x == 1), np.flatnonzero(x == -1)], 1).tolist())
    return out


def _union(a: list, b: list) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _hits(automaton):
    """Rows that a part of the benchmark hits, with ids and ranges."""

    def run(batches):
        matcher = automaton.value
        for batch in batches:
            at, ids, ranges, base = [], [], [], 0
            for words, hits, items, hit, bounds in matcher.scan(batch.column(2)):
                if hits.any():
                    every = _ranges(hit, bounds)
                    for d in np.flatnonzero(hits).tolist():
                        at.append(base + d)
                        ids.append(sorted(items[d]))
                        ranges.append(every[d])
                base += len(words)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(ids, pa.list_(pa.string())), pa.array(ranges, pa.list_(pa.list_(pa.int64())))], names=[SRC, ROW, "ids", "ranges"]
            )

    return run


def _merge(batches):
    for batch in batches:
        ids = [sorted(set(x)) for x in batch.column(2).to_pylist()]
        ranges = [_union(x, []) for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ids, pa.list_(pa.string())), pa.array(ranges, pa.list_(pa.list_(pa.int64())))], names=[SRC, ROW, "_sm_ids", "_sm_ranges"])


def _pass(automaton, text_at: int):
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("item_ids", pa.list_(pa.string())), ("hit_ranges", pa.list_(pa.list_(pa.int64())))])

    def run(batches):
        matcher = automaton.value
        for batch in batches:
            rows = []
            for words, hits, items, hit, bounds in matcher.scan(batch.column(text_at)):
                touched = hits > 0
                ranges = _ranges(hit, bounds) if touched.any() else [[]] * len(words)
                rows += [
                    {"n_words": int(n), "n_hit": int(x), "n_items": len(i), "item_ids": sorted(i), "hit_ranges": r}
                    for n, x, i, r in zip(words, hits, items, ranges, strict=True)
                ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "contamination"])

    return run


def digest_columns(found: DataFrame) -> DataFrame:
    """The columns of the registered query: one row for each document."""
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        c["n_items"].alias("n_items"),
        F.sha2(F.array_join(c["item_ids"], ","), 256).alias("items_sha256"),
        (c["n_hit"] > 0).alias("contaminated"),
    )
