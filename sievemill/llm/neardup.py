"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words; a text of fewer words, but not none, is one shingle. A shingle weighs its count in the text
times its inverse document frequency, 1 + ln(texts / df) / ln(texts), where df is exact: the number of all distinct texts that
hold it, counted for every shingle. Each text gets 64 consistent weighted samples;
two texts agree in one with the probability of their weighted Jaccard similarity. Bands of four samples make
buckets. In each bucket the member that shares most buckets is the hub, and every other member is verified against
it by weighted Jaccard similarity; members of a bucket that ends up in several classes meet again in finer buckets
of two bands, with other hubs. Pairs that share a bucket and are still in different classes are then verified one by
one, in blocks of a bucket's members. Verified links make classes by connected components.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import Words, mix, text_blocks
from .shared import ROW, SRC, Scratch, identified, set_aside, split_rows, without_rows

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
#: Rows of a file that make a chunk, as a power of two; texts of at least ``LONG`` bytes are chunks of their own.
CHUNK_ROWS, LONG = 11, 1 << 15
#: A chunk's columns.
CHUNK = [SRC, "_sm_near", "_sm_alone"]
#: Shingles of one list, and entries that an owner gathers on average.
LIST, OWNED = 1 << 22, 1 << 21
#: Bands that the finest buckets with hubs share.
LEVELS = 2
#: Rounds of components whose labels are composed in one plan.
COMPOSED = 8
#: Members of a bucket that meet another such block, or each other, in one group.
BLOCK = 128
_MASK = np.uint64((1 << 50) - 1)
_C = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, shingle of 50 bits, count)``, ordered by document, then shingle."""
    h, bounds = words.hashes, words.bounds
    n = np.diff(bounds)
    doc = words.doc_of()
    full = np.zeros(len(h), np.uint64)
    size = len(h) - SHINGLE + 1
    if size > 0:
        for j in range(SHINGLE):
            full[:size] += h[j : j + size] * _C[j]
    left = np.repeat(bounds[1:], n) - np.arange(len(h))
    at = left >= SHINGLE
    value, owner = full[at], doc[at]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        whole = [sum((int(h[bounds[d] + j]) * int(_C[j]) for j in range(n[d])), int(n[d])) & ((1 << 64) - 1) for d in short.tolist()]
        value, owner = np.concatenate([value, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    key = (owner.astype(np.uint64) << np.uint64(50)) | (mix(value) & _MASK)
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    return (key[first] >> np.uint64(50)).astype(np.int64), key[first] & _MASK, np.diff(first, append=len(key))


def idf(df: np.ndarray, texts: int) -> np.ndarray:
    """1 + ln(texts / df) / ln(texts): from 1 for a shingle of every text to 2 for one of a single text, at any size of corpus."""
    return 1.0 + np.log(texts / df) / np.log(max(2, texts))


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs; the first byte says how many."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + raw.tobytes()


def unpack(code: bytes) -> np.ndarray:
    raw = np.frombuffer(code, np.uint8, offset=1).reshape(-1, code[0])
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : code[0]] = raw
    return out.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """The same for rising integers, by their gaps."""
    return len(values[:1]).to_bytes(1, "little") + (int(values[0]).to_bytes(8, "little") + pack(np.diff(values)) if len(values) else b"")


def unpack_sorted(code: bytes) -> np.ndarray:
    if not code[0]:
        return np.empty(0, np.uint64)
    first = np.array([int.from_bytes(code[1:9], "little")], np.uint64)
    return np.cumsum(np.concatenate([first, unpack(code[9:])]), dtype=np.uint64)


def pack_frequencies(df: np.ndarray) -> bytes | None:
    """A text's document frequencies in the order of its shingles: a bit for each, and a number for those above one."""
    more = df > 1
    return np.packbits(more).tobytes() + pack(df[more]) if more.any() else None


def unpack_frequencies(code: bytes | None, n: int) -> np.ndarray:
    df = np.ones(n, np.int64)
    if code is not None:
        size = -(-n // 8)
        df[np.unpackbits(np.frombuffer(code, np.uint8, size))[:n].astype(bool)] = unpack(code[size:]).astype(np.int64)
    return df


def _gamma_table(bits: int = 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of 2**bits equal steps, by Newton's method."""
    u = (np.arange(1 << bits) + 0.5) / (1 << bits)
    x = np.sqrt(2 * u) + u
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x) + 1e-300), x / 4)
    return x


class Sampler:
    """Improved consistent weighted sampling; the variates of a shingle come from its hash through quantile tables.

    In logarithms, a shingle of weight w has t = floor(ln w / r + beta) and a = ln c - r (t - beta + 1); the least a is the sample,
    named by its shingle and t.
    """

    def __init__(self, samples: int = BANDS * ROWS):
        x = _gamma_table()
        self.r, self.log_c = x.astype(np.float32), np.log(x).astype(np.float32)
        seeds = mix(np.arange(1, 2 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.odd, self.add = seeds[:samples] | np.uint64(1), seeds[samples:]

    def sample(self, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """``(samples, len(docs))``: for each document of ``docs`` (those that have shingles) a 32-bit name of its sample."""
        n, begin = len(shingle), np.searchsorted(doc, docs)
        sizes = np.diff(begin, append=n)
        log_w = np.log(weight).astype(np.float32)
        out = np.empty((len(self.odd), len(docs)), np.uint32)
        x, y = np.empty(n, np.uint64), np.empty(n, np.uint64)
        parts = x.view(np.uint16).reshape(n, 4)  # little-endian: parts[:, 3] is the top
        at = np.empty(n, np.intp)
        r, a, t, beta = (np.empty(n, np.float32) for _ in range(4))
        for i, (odd, add) in enumerate(zip(self.odd, self.add, strict=True)):
            np.multiply(shingle, odd, out=x)
            np.add(x, add, out=x)
            np.right_shift(x, np.uint64(31), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint64(0xC4CEB9FE1A85EC53), out=x)
            at[:] = parts[:, 3]
            np.take(self.r, at, out=r, mode="clip")
            at[:] = parts[:, 2]
            np.take(self.log_c, at, out=a, mode="clip")
            beta[:] = parts[:, 1]
            np.multiply(beta, np.float32(1 / 65536), out=beta)
            np.divide(log_w, r, out=t)
            np.add(t, beta, out=t)
            np.floor(t, out=t)
            np.subtract(t, beta, out=beta)
            np.add(beta, np.float32(1), out=beta)
            np.multiply(beta, r, out=beta)
            np.subtract(a, beta, out=a)
            least = np.minimum.reduceat(a, begin)
            won = np.flatnonzero(a == np.repeat(least, sizes))
            name = x[won] ^ (x[won] >> np.uint64(29))
            name += t[won].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)
            # of equal a, the smallest name
            out[i] = np.minimum.reduceat(name & np.uint64(0xFFFFFFFF), np.searchsorted(won, begin))
        return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two vectors ``(sorted shingles, weights)``; two empty ones have 0."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    least = np.minimum(a[1][hit], b[1][at[hit]]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def _vectors(column, frequencies, texts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(sorted shingles, weights)`` of each text, whose document frequencies come with it."""
    out, codes = [], frequencies.to_pylist()
    for lo, hi, buf, offsets in text_blocks(column):
        d, s, n = shingles(Words(buf, offsets))
        cuts = np.searchsorted(d, np.arange(hi - lo + 1))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), lo):
            out.append((s[a:b], n[a:b] * idf(unpack_frequencies(codes[i], int(b - a)), texts)))
    return out


def _names(batches):
    """Rows to the 128-bit name of their sequence of words, null without words, and the number of words."""
    for batch in batches:
        names, sizes = [], []
        for lo, hi, buf, offsets in text_blocks(batch.column(batch.num_columns - 1)):
            w = Words(buf, offsets)
            sizes += np.diff(w.bounds).tolist()
            # words parted by one blank: all bytes of words and the byte behind each
            low = np.append(w.low, np.uint8(32))
            keep = np.zeros(len(low) + 1, np.int8)
            keep[w.starts] += 1  # no two words start, or end, at one byte
            keep[w.ends] -= 1
            inside = np.cumsum(keep[:-1]) > 0
            spread = np.concatenate([[0], np.cumsum(inside)])
            raw = low[inside].tobytes()
            lengths = (w.ends - w.starts).astype(np.uint32)
            for d in range(hi - lo):
                a, b = int(w.bounds[d]), int(w.bounds[d + 1])
                if a == b:
                    names.append(None)
                    continue
                h = hashlib.blake2b(raw[int(spread[w.starts[a]]) : int(spread[w.ends[b - 1]])], digest_size=16)
                h.update(lengths[a:b].tobytes())
                names.append(h.digest())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.binary()), pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "node", "n_words"])


def _lists(owners: int):
    """Texts, in the order of their chunks, to messages: an owner's share of a chunk's sorted distinct shingles, with those of several texts."""

    def message(key, held):
        s = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.diff(s, prepend=~s[:1]))
        s, n = s[first], np.diff(first, append=len(s))
        own = ((s >> np.uint64(18)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(s))
        rows = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            more = np.flatnonzero(n[a:b] > 1)
            rows.append((*key, int(own[a]), pack_sorted(s[a:b]), pack_sorted(more), pack(n[a:b][more])))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*CHUNK, "owner", "code", "places", "counts"])

    def run(batches):
        last, held, size = None, [], 0
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            for lo, hi, buf, offsets in text_blocks(batch.column(3)):
                d, s, _ = shingles(Words(buf, offsets))
                mine = keys[lo:hi]
                begin = np.flatnonzero(np.append(True, (mine[1:] != mine[:-1]).any(1)))
                cuts = np.searchsorted(d, np.append(begin, hi - lo))
                for i, a, b in zip(begin.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    key = tuple(mine[i].tolist())
                    if held and (key != last or size + b - a > LIST):
                        yield message(last, held)
                        held, size = [], 0
                    last = key
                    if b > a:
                        held.append(s[a:b])
                        size += b - a
        if held:
            yield message(last, held)

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """An owner's answers: to each list its shingles that more than one text holds, with the number of texts."""
    lists = [unpack_sorted(c) for c in table.column("code").to_pylist()]
    ends = np.cumsum([len(x) for x in lists])
    count = np.ones(int(ends[-1]), np.int64)
    for end, x, places, counts in zip(ends, lists, table.column("places").to_pylist(), table.column("counts").to_pylist(), strict=True):
        if places[0]:
            count[end - len(x) + unpack_sorted(places).astype(np.int64)] = unpack(counts)
    every = np.concatenate(lists)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.diff(every, prepend=~every[:1]))
    total = np.add.reduceat(count[order], first)
    df = np.empty(len(order), np.int64)
    df[order] = np.repeat(total, np.diff(first, append=len(order)))
    shared, found = [], []
    for x, mine in zip(lists, np.split(df, ends[:-1]), strict=True):
        more = mine > 1
        shared.append(pack_sorted(x[more]))
        found.append(pack(mine[more]))
    return table.select(CHUNK).append_column("shared", pa.array(shared, pa.binary())).append_column("df", pa.array(found, pa.binary()))


def _signer(texts: int):
    """A chunk's texts and the frequencies of its shared shingles to ``(row, bands, frequencies)``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sampler = _sampler()
        known, df = np.empty(0, np.uint64), np.empty(0, np.int64)
        if right.num_rows:
            known = np.concatenate([unpack_sorted(c) for c in right.column("shared").to_pylist()])
            known, at = np.unique(known, return_index=True)
            df = np.concatenate([unpack(c) for c in right.column("df").to_pylist()]).astype(np.int64)[at]
        keep, bands, codes = [], [], []
        for lo, hi, buf, offsets in text_blocks(left.column("low")):
            d, s, n = shingles(Words(buf, offsets))
            docs = np.unique(d)
            if not len(docs):
                continue
            mine = np.ones(len(s), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                hit = known[at] == s
                mine[hit] = df[at[hit]]
            got = sampler.sample(d, s, n * idf(mine, texts), docs).astype(np.uint64)
            key = np.zeros((BANDS, len(docs)), np.uint64)
            for j in range(ROWS):
                key = mix(key * _C[0] + got[j::ROWS] + _C[1])
            bands.append(key.T)
            keep.append(docs + lo)
            codes += [pack_frequencies(x) for x in np.split(mine, np.searchsorted(d, docs[1:]))]
        at = pa.array(np.concatenate(keep) if keep else np.empty(0, np.int64))
        flat = np.concatenate(bands).ravel().view(np.int64) if bands else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * BANDS), pa.array(flat))
        rows = [left.column(c).take(at) for c in (SRC, ROW)]
        return pa.table([*rows, lists, pa.array(codes, pa.binary())], names=[SRC, ROW, "bands", "df"])

    return run


@cache
def _sampler() -> Sampler:
    return Sampler()


def signatures(texts: DataFrame, n: int, n_words: int, scratch: Scratch) -> DataFrame:
    """``(_sm_src, _sm_row, bands, df)`` of ``texts (_sm_src, _sm_row, low)``, ``n`` distinct ones of ``n_words`` words together.

    Document frequencies of all shingles are counted by exchange: chunks of texts send owners (ranges of shingles, some ``OWNED``
    entries each) their sorted distinct shingles, and owners answer with those that more than one text holds and how many do; all others
    are in one text only. Chunks are rows of one file, so texts are shuffled once, to meet the answers.
    """
    near = F.shiftright(ROW, CHUNK_ROWS)
    alone = F.when(F.octet_length("low") >= LONG, F.col(ROW) + 1).otherwise(F.lit(0).cast("long"))
    rows = texts.select(SRC, ROW, near.alias("_sm_near"), alone.alias("_sm_alone"), "low")
    owners = max(1, -(-n_words // OWNED))
    keys = ", ".join(f"{c} long" for c in CHUNK)
    lists = rows.select(*CHUNK, "low").mapInArrow(_lists(owners), f"{keys}, owner int, code binary, places binary, counts binary")
    answers = scratch.put(lists.groupBy("owner").applyInArrow(_frequencies, f"{keys}, shared binary, df binary"), "answers")
    both = rows.groupBy(*CHUNK).cogroup(answers.groupBy(*CHUNK))
    return both.applyInArrow(_signer(n), f"{SRC} long, {ROW} long, bands array<long>, df binary")


#: Pairs whose vectors are in memory at a time.
SLICE = 256


def _verifier(texts: int):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                a, b, text_a, text_b, df_a, df_b = whole.slice(at, SLICE).columns
                names = b.to_pylist()
                first = {x: i for i, x in reversed(list(enumerate(names)))}
                take = sorted(first.values())
                few = pa.array(take, pa.int64())
                hubs = dict(zip((names[i] for i in take), _vectors(text_b.take(few), df_b.take(few), texts), strict=True))
                score = [weighted_jaccard(x, hubs[y]) for x, y in zip(_vectors(text_a, df_a, texts), names, strict=True)]
                yield pa.RecordBatch.from_arrays([a, b, pa.array(score, pa.float64())], names=["a", "b", "similarity"])

    return run


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(node, label)`` of every node of ``edges (a, b)``, by contraction of stars.

    Each round gives every hub ``b`` and its members the smallest of them, then every member the smallest of its hubs'.
    Where a member saw several, those labels are the edges of the next, far smaller round; labels are composed at the end.
    Rounds go on until no edge is left: each joins at least one more node to a smaller one, a chain of rising names just one.
    """
    rounds = []
    for i in count():
        least = scratch.put(edges.groupBy("b").agg(F.min("a").alias("m")), f"{name}-least-{i}")
        stars = edges.join(least, "b").select("a", F.least("b", "m").alias("m"))
        spread = stars.select(F.col("a").alias("n"), "m").union(least.select(F.col("b").alias("n"), F.least("b", "m").alias("m")))
        best = spread.groupBy("n").agg(F.min("m").alias("label"), F.collect_set("m").alias("all"))
        best = scratch.put(best, f"{name}-{i}")
        rounds.append(best.select(F.col("n").alias("node"), "label"))
        edges = best.filter(F.size("all") > 1).select(F.explode("all").alias("a"), F.col("label").alias("b")).filter("a != b").distinct()
        edges = scratch.put(edges, f"{name}-edges-{i}")
        if edges.isEmpty():
            break
    labels = rounds[-1]
    for i, earlier in enumerate(reversed(rounds[:-1]), 1):
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("final"))
        labels = earlier.join(later, "label", "left").select("node", F.coalesce("final", "label").alias("label"))
        if i % COMPOSED == 0:
            labels = scratch.put(labels, f"{name}-labels-{i}")
    return labels


def near_groups(docs: DataFrame, scratch: Scratch, *, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs`` (identified): _sm_src, _sm_row, doc_id, class_id, class_size, n_links, kept.

    Texts are compared as sequences of lower-cased words; equal sequences are one node, and only nodes are sampled and linked, so
    copies cost one row each. ``class_id`` is the smallest id of the class (null only if all are null), ``n_links`` the number of
    verified links of the row's text to different texts, ``kept`` marks one row of each class: that of the smallest id, nulls
    last. Rows without a word (null and empty texts among them) are classes of their own. An empty table gives an
    empty result. Other columns, of any name, are not read.
    """
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    slim = scratch.put(
        docs.select(SRC, ROW, F.col(id_col).alias("doc_id"), low.alias("low")).mapInArrow(
            _names, f"{SRC} long, {ROW} long, doc_id {docs.schema[id_col].dataType.simpleString()}, node binary, n_words long"
        ),
        "names",
    )
    named = slim.filter("node is not null").groupBy("node").agg(F.min(F.struct(SRC, ROW)).alias("at"), F.first("n_words").alias("n_words"))
    nodes = scratch.put(named.select("node", f"at.{SRC}", f"at.{ROW}", "n_words"), "nodes")
    n, n_words = nodes.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    only, _ = split_rows(docs.select(SRC, ROW, low.alias("low")), nodes.select(SRC, ROW), scratch, "node-bits")
    signed = signatures(only, n, n_words, scratch)
    signed = scratch.put(signed.join(nodes, [SRC, ROW]).select("node", SRC, ROW, "bands", "df"), "signed")

    members = signed.select("node", F.posexplode("bands").alias("band", "bucket"))
    members = members.select("node", "band", F.xxhash64("band", "bucket").alias("bucket"))
    # aggregates that are joined back to their rows are written first: then both sides of the join are plain exchanges, and
    # Spark can split the rows of a bucket, hub or group that holds a third of them
    shared = scratch.put(members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    members = scratch.put(members.join(shared, "bucket"), "members")
    fame = members.groupBy("node").agg(F.sum("n").alias("fame"))
    members = scratch.put(members.join(fame, "node").select("node", "band", "bucket", "fame", F.col("node").alias("label")), "famed")
    links, texts, labels, famed, first_hubs = None, None, None, members, None
    for level in range(1, LEVELS + 1):
        # the first hubs are the most widely shared texts, later ones the least, so that no hub is tried twice in vain
        order = F.struct((F.col("fame") if level == 1 else -F.col("fame")).alias("o"), "node", "label")
        hubs = members.groupBy("bucket").agg(F.max(order).alias("hub"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y")
        hubs = scratch.put(hubs.select("bucket", F.col("hub.node").alias("b"), F.col("hub.label").alias("hub_label")), f"hubs-{level}")
        first_hubs = hubs if first_hubs is None else first_hubs
        pairs = members.join(hubs, "bucket").filter("label != hub_label").select(F.col("node").alias("a"), "b").distinct()
        pairs = scratch.put(pairs, f"pairs-{level}")
        if pairs.isEmpty():
            break
        if texts is None:
            texts = _texts(docs, low, members, signed, scratch)
        scored = scratch.put(_similar(pairs, texts, n), f"scored-{level}")
        good = scored.filter(F.col("similarity") >= threshold).select("a", "b")
        links = good if links is None else links.union(good)
        if labels is None or not good.isEmpty():
            labels = scratch.put(components(links, scratch, f"star-{level}"), f"labels-{level}")
        if level == LEVELS:
            break
        # buckets that still hold several classes are cut finer by a further band of their members
        tagged = members.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        tagged = scratch.put(tagged, f"tagged-{level}")
        torn = tagged.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("bucket")
        torn = scratch.put(torn, f"torn-{level}")
        more = members.select("node", F.col("band").alias("more_band"), F.col("bucket").alias("more"))
        finer = tagged.join(torn, "bucket", "left_semi").join(more, "node").filter("more_band > band")
        members = scratch.put(finer.select("node", F.col("more_band").alias("band"), F.xxhash64("bucket", "more").alias("bucket"), "fame", "label"), f"members-{level + 1}")

    if labels is not None:
        good = scratch.put(_rest(famed, first_hubs, labels, texts, signed, n, threshold, scratch), "scored-rest").select("a", "b")
        if not good.isEmpty():
            links = links.union(good)
            labels = scratch.put(components(links, scratch, "star-rest"), "labels-rest")

    out = slim
    if labels is None:
        out = out.withColumn("label", F.col("node")).withColumn("n_links", F.lit(0).cast("long"))
    else:
        degree = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().groupBy("a").agg(F.count("*").alias("d"))
        known = labels.join(degree, labels["node"] == degree["a"], "left").select(F.col("node"), F.col("label").alias("l"), F.coalesce("d", F.lit(0)).alias("d"))
        known = scratch.put(known, "known")
        out = out.join(known, "node", "left").withColumn("label", F.coalesce("l", "node")).withColumn("n_links", F.coalesce("d", F.lit(0)).cast("long")).drop("l", "d")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", SRC, ROW)
    out = scratch.put(out.select(SRC, ROW, "doc_id", "label", "n_links"), "labelled")
    sized = out.filter("label is not null").groupBy("label").agg(F.min(rank).alias("keep"), F.count("*").alias("size")).filter("size > 1")
    sized = scratch.put(sized.select(F.col("label").alias("g"), "keep", "size"), "classes")
    joined = out.join(sized, F.col("label") == F.col("g"), "left")
    return joined.select(
        SRC,
        ROW,
        "doc_id",
        F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("class_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("class_size"),
        "n_links",
        (F.col("g").isNull() | ((F.col(f"keep.{SRC}") == F.col(SRC)) & (F.col(f"keep.{ROW}") == F.col(ROW)))).alias("kept"),
    )


def _texts(docs: DataFrame, low, members: DataFrame, signed: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, low, df)`` of the nodes that share a bucket, written once: only these texts are shuffled again."""
    wanted = members.select("node").distinct().join(signed.select("node", SRC, ROW, "df"), "node")
    rows, _ = split_rows(docs.select(SRC, ROW, low.alias("low")), wanted.select(SRC, ROW), scratch, "text-bits")
    return scratch.put(rows.join(wanted, [SRC, ROW]).select("node", "low", "df"), "texts")


def _similar(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Similarity of each pair; a hub's text meets its members' in a skew-safe join."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("low").alias(f"text_{x}"), F.col("df").alias(f"df_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b", "df_a", "df_b")
    return both.mapInArrow(_verifier(n), "a binary, b binary, similarity double")


def _judge(texts: int, threshold: float):
    """All pairs of a group's two blocks (or its one) that are of different classes and meet in no earlier band."""

    def run(key, table):
        at, i, j = key[1].as_py(), key[2].as_py(), key[3].as_py()
        node, label, own, bands, low, df = (table.column(c).combine_chunks() for c in ("node", "label", "own", "bands", "low", "df"))
        own, bands = own.to_numpy(), bands.flatten().to_numpy().reshape(len(node), BANDS)
        label = label.dictionary_encode().indices.to_numpy()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        need = label[left][:, None] != label[right]
        if i == j:
            need = np.triu(need, 1)
        for b in range(at + 1):
            same = bands[left, b][:, None] == bands[right, b]
            need &= same if b == at else ~same
        a, b, score = [], [], []
        if need.any():
            v = _vectors(low, df, texts)
            right_s, right_w = (np.concatenate([v[y][k] for y in right]) for k in (0, 1))
            begin = np.cumsum([0, *[len(v[y][0]) for y in right[:-1]]])
            known, place = np.unique(right_s, return_inverse=True)
            total = np.add.reduceat(right_w, begin)
            for x in np.flatnonzero(need.any(axis=1)):
                s, w = v[left[x]]
                where = np.minimum(np.searchsorted(known, s), len(known) - 1)
                hit = known[where] == s
                mine = np.zeros(len(known))
                mine[where[hit]] = w[hit]
                least = np.add.reduceat(np.minimum(mine[place], right_w), begin)
                # sums in another order may differ in the last digits: the exact test is that of the hubs
                for y in np.flatnonzero(need[x] & (least >= (threshold - 1e-6) * (w.sum() + total - least))):
                    similarity = weighted_jaccard(v[left[x]], v[right[y]])
                    if similarity >= threshold:
                        a.append(node[int(left[x])].as_py())
                        b.append(node[int(right[y])].as_py())
                        score.append(similarity)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "similarity": pa.array(score, pa.float64())})

    return run


def _rest(members: DataFrame, hubs: DataFrame, labels: DataFrame, texts: DataFrame, signed: DataFrame, n: int, threshold: float, scratch: Scratch) -> DataFrame:
    """Links among the pairs that share a bucket, are of different classes and of which neither is the bucket's hub.

    The members of a bucket's largest class need not meet each other: blocks of the others meet all blocks, so a group has at most
    some two blocks of texts whatever the bucket's size, and a text goes to as many groups as there are blocks for it to meet.
    """
    left = members.select("node", "band", "bucket").join(hubs.select("bucket", "b"), "bucket").filter("node != b").drop("b")
    left = scratch.put(left.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "left")
    classes = left.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    sizes = classes.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("classes")).filter("classes > 1")
    sizes = scratch.put(sizes.select("bucket", "n", F.col("top.n").alias("most"), F.col("top.label").alias("main")), "sizes")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    single, main, here = F.col("n") <= BLOCK, F.col("label") == F.col("main"), F.xxhash64("node")
    few, many = blocks(F.col("n") - F.col("most")), blocks(F.col("most"))
    own = F.when(single, 0).when(main, few + F.pmod(here, many)).otherwise(F.pmod(here, few)).cast("int")
    meets = F.when(single, F.array(F.lit(0))).when(main, F.sequence(F.lit(0), few - 1)).otherwise(F.sequence(F.lit(0), few + many - 1))
    rows = left.join(sizes, "bucket").select("node", "band", "bucket", "label", own.alias("own"), meets.alias("meets"))
    rows = rows.join(texts, "node").join(signed.select("node", "bands"), "node").withColumn("other", F.explode("meets")).drop("meets")
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
    return rows.groupBy("bucket", "band", "i", "j").applyInArrow(_judge(n, threshold), "a binary, b binary, similarity double")


def near_dedup(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class (see ``near_groups``); columns as they were, texts not shuffled."""
    scratch = Scratch(docs.sparkSession, "near")
    safe, restore = set_aside(docs)
    rows = identified(safe, scratch)
    dropped = near_groups(rows, scratch, text_col=text_col, id_col=id_col, threshold=threshold).filter("not kept").select(SRC, ROW)
    return restore(without_rows(rows, dropped, scratch, "near-bits"))


__all__ = ["Sampler", "components", "idf", "near_dedup", "near_groups", "shingles", "weighted_jaccard"]
