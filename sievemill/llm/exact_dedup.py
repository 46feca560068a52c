"""Exact duplicates by Golomb-coded fingerprint exchange.

1. Each row of the scan gets a short fingerprint of its normalised text (a slim table, no text).
2. Senders (tasks over the slim table) sort their distinct fingerprints, cut them by owner (their leading
   bits) and send each owner the gaps, Golomb-coded.
3. Owners decode the lists they got and answer each with a bitmap: which of its entries occur elsewhere.
4. Bitmaps go back to the lists they answer, in blocks of files, and the addresses behind the lists stay where they were written.
   Rows behind set bits, or behind entries that a sender holds several rows of, are suspects. Only
   suspects' texts are read again and shuffled; equal bytes, not equal fingerprints, make a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ROW, SRC, Scratch, identified, set_aside, split_rows, without_rows

#: Bits of a fingerprint beyond log2 of the rows: of N distinct texts, about N / 2**24 are suspected in vain.
SPARE_BITS = 24
#: Bytes of bitmaps that are broadcast at a time.
BLOCK_BYTES = 64 << 20
#: Fingerprints that an owner gathers, and rows that a sender sorts at a time.
OWNER_ROWS, SENDER_ROWS = 1 << 21, 1 << 20


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of blanks, tabs and line ends counts as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted non-negative integers as gaps: quotients in unary, then remainders of ``k`` bits. Returns ``(k, code)``."""
    n = len(values)
    if not n:
        return 0, b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = int(max(0, np.floor(np.log2(max(1.0, float(values[-1]) / n * 0.6931)))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(ends[-1], np.uint8)
    unary[ends - 1] = 1
    head = np.packbits(unary).tobytes()
    rest = b""
    if k:
        shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
        rest = np.packbits(((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)).tobytes()
    return k, len(head).to_bytes(4, "little") + head + rest


def golomb_decode(n: int, k: int, code: bytes) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    size = int.from_bytes(code[:4], "little")
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, size, 4)))[:n]
    gaps = (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(code, np.uint8, offset=4 + size))[: n * k].reshape(n, k)
        for j in range(k):
            gaps |= bits[:, j].astype(np.uint64) << np.uint64(k - 1 - j)
    return np.cumsum(gaps, dtype=np.uint64)


def _send(owners: int, width: int):
    """Slim rows to messages: an owner's share of the sender's sorted fingerprints, with the rows behind them."""

    def message(fp, src, row):
        order = np.argsort(fp, kind="stable")
        fp, src, row = fp[order], src[order], row[order]
        first = np.flatnonzero(np.diff(fp, prepend=fp[0] - np.uint64(1)))
        distinct, many = fp[first], np.diff(first, append=len(fp))
        # fingerprints are below 2**width, so the product of their top bits and the owners stays in 64 bits
        own = ((distinct >> np.uint64(max(0, width - 32))) * np.uint64(owners) >> np.uint64(min(32, width))).astype(np.int64)
        out = []
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=True):
            lo, hi = int(first[a]), int(first[b]) if b < len(first) else len(fp)
            k, code = golomb_encode(distinct[a:b])
            out.append((int(own[a]), b - a, k, code, many[a:b].astype(np.int32).tobytes(), src[lo:hi].tobytes(), row[lo:hi].tobytes()))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        names = ["owner", "n", "k", "code", "many", "srcs", "rows"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            size += batch.num_rows
            if size >= SENDER_ROWS:
                yield message(np.concatenate([h[0] for h in held]).astype(np.uint64), *(np.concatenate([h[i] for h in held]) for i in (1, 2)))
                held, size = [], 0
        if size:
            yield message(np.concatenate([h[0] for h in held]).astype(np.uint64), *(np.concatenate([h[i] for h in held]) for i in (1, 2)))

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: which entries of each list occur in another list too."""
    lists = [golomb_decode(n, k, code) for n, k, code in zip(pdf["n"], pdf["k"], pdf["code"], strict=True)]
    _, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    twice = np.split(counts[inverse] > 1, np.cumsum([len(x) for x in lists])[:-1])
    return pd.DataFrame({SRC: pdf[SRC], ROW: pdf[ROW], "bitmap": [np.packbits(t).tobytes() for t in twice]})


def _suspects(batches):
    for batch in batches:
        srcs, rows = [], []
        for n, bitmap, many, src, row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            many = np.frombuffer(many, np.int32)
            bad = np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n].astype(bool) | (many > 1)
            at = np.repeat(bad, many)
            srcs.append(np.frombuffer(src, np.int64)[at])
            rows.append(np.frombuffer(row, np.int64)[at])
        if srcs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(srcs)), pa.array(np.concatenate(rows))], names=[SRC, ROW])


def exact_groups(docs: DataFrame, scratch: Scratch, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: _sm_src, _sm_row, doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` must be identified. Of equal texts the row with the smallest id stays; a null id comes after all
    others, and of rows with the same text and id exactly one stays. Empty and null texts form one group.
    An empty table gives an empty result; texts of any length are compared whole.
    """
    norm = normalised(F.col(text_col))
    n = docs.count()
    width = min(63, max(1, int(n).bit_length()) + SPARE_BITS)
    owners = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // OWNER_ROWS))
    base = docs.select(SRC, ROW, F.col(id_col).alias("doc_id"), norm.alias("norm"))
    slim = scratch.put(
        base.select(SRC, ROW, "doc_id", F.sha2("norm", 256).alias("text_sha256"), F.shiftrightunsigned(F.xxhash64("norm"), 64 - width).alias("fp")),
        "slim",
    )
    sent = scratch.put(
        slim.select("fp", SRC, ROW).mapInArrow(_send(owners, width), "owner int, n int, k int, code binary, many binary, srcs binary, rows binary"),
        "sent",
    )
    sent = identified(sent, scratch)  # a list is named by where it was written, so its answer finds it without a move of the addresses
    answers = sent.select(SRC, ROW, "owner", "n", "k", "code").groupBy("owner").applyInPandas(_answer, f"{SRC} long, {ROW} long, bitmap binary")
    answers = scratch.put(answers, "answers")
    blocks, behind = max(1, -(-(answers.agg(F.sum(F.octet_length("bitmap"))).first()[0] or 0) // BLOCK_BYTES)), None
    for b in range(blocks):
        mine = (lambda d: d) if blocks == 1 else (lambda d, b=b: d.filter(F.pmod(F.xxhash64(SRC), F.lit(blocks)) == b))
        joined = mine(sent).join(F.broadcast(mine(answers)), [SRC, ROW]).select("n", "bitmap", "many", "srcs", "rows")
        found = joined.mapInArrow(_suspects, f"{SRC} long, {ROW} long")
        behind = found if behind is None else behind.unionByName(found)
    suspects = scratch.put(behind, "suspects")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", SRC, ROW)
    texts, _ = split_rows(base_rows(docs, text_col, id_col), suspects, scratch, "suspect-bits")
    groups = (
        texts.select(SRC, ROW, "doc_id", normalised(F.col("text")).alias("norm"))
        .groupBy(F.sha2("norm", 256).alias("g_sha"), "norm")
        .agg(F.min(rank).alias("keep"), F.count("*").alias("g_size"))
        .filter("g_size > 1")
        .select("g_sha", "keep", "g_size")
    )
    maybe, alone = split_rows(slim.drop("fp"), suspects, scratch, "suspect-bits-slim")
    joined = maybe.join(groups, F.col("text_sha256") == F.col("g_sha"), "left")
    return joined.select(
        SRC,
        ROW,
        "doc_id",
        F.when(F.col("g_sha").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("g_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("g_sha").isNull() | ((F.col(f"keep.{SRC}") == F.col(SRC)) & (F.col(f"keep.{ROW}") == F.col(ROW)))).alias("kept"),
        "text_sha256",
    ).unionByName(
        alone.select(SRC, ROW, "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    )


def base_rows(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(SRC, ROW, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def exact_dedup(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose text repeats that of a kept row (see ``exact_groups``); columns as they were."""
    scratch = Scratch(docs.sparkSession, "exact")
    safe, restore = set_aside(docs)
    rows = identified(safe, scratch)
    dropped = exact_groups(rows, scratch, text_col=text_col, id_col=id_col).filter("not kept").select(SRC, ROW)
    return restore(without_rows(rows, dropped, scratch, "dropped-bits"))
