"""Hashed-text features and linear models that share one scoring pass over the bytes of a column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .bytesops import IS_WORD, LOWER, Words, mix, powers, sums_by, text_blocks

#: Buckets of the feature hash.
BITS = 18
#: Bytes that separate tokens when punctuation counts: blanks only.
IS_VISIBLE = np.ones(256, bool)
IS_VISIBLE[:33] = False
IS_VISIBLE[127] = False
IDENTITY = np.arange(256, dtype=np.uint8)


def token_features(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, document)`` of each feature: lower-cased words, their first six bytes, and the shape of each blank-free token.

    A shape tells what the bytes are (lower, upper, digit, other), with runs cut to one; it sees what words can't:
    symbols glued to words, capitals, tables.
    """
    w = Words(buf, offsets)
    doc = w.doc_of()
    words = w.hashes >> np.uint64(64 - bits)
    p, q = powers(len(w.low) + 1)
    sums = np.zeros(len(w.low) + 1, np.uint64)
    np.cumsum(w.low.astype(np.uint64) * p[: len(w.low)], out=sums[1:])
    cut = np.minimum(w.ends, w.starts + 6)
    prefixes = mix((sums[cut] - sums[w.starts]) * q[w.starts] ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - bits)
    marks, shape_doc = token_shapes(buf, offsets)
    shapes = mix(marks ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - bits)
    return np.concatenate([words, prefixes, shapes]).astype(np.int64), np.concatenate([doc, doc, shape_doc])


def token_shapes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash of the shape, document)`` of each blank-free token."""
    shape = _SHAPE[buf]
    runs = Words(_SHAPE_BYTES[shape] if len(buf) else buf, offsets, _SHAPE_TOKEN, IDENTITY)
    return _run_hashes(runs), runs.doc_of()


_SHAPE = np.full(256, 5, np.uint8)
_SHAPE[97:123] = 1
_SHAPE[128:] = 1
_SHAPE[65:91] = 2
_SHAPE[48:58] = 3
_SHAPE[~IS_VISIBLE] = 0
for _i, _c in enumerate(b"%$#&*|!@<>{}[]=+~^_\\/"):
    _SHAPE[_c] = 6 + _i
_SHAPE_BYTES = np.arange(256, dtype=np.uint8)
_SHAPE_TOKEN = np.ones(256, bool)
_SHAPE_TOKEN[0] = False


def _run_hashes(tokens: Words) -> np.ndarray:
    """A hash of each token's shape with runs of one class cut to one byte."""
    low = tokens.low
    if not len(low):
        return np.empty(0, np.uint64)
    change = np.ones(len(low), bool)
    change[1:] = low[1:] != low[:-1]
    change[tokens.starts] = True
    place = np.cumsum(change)
    p, q = powers(len(low) + 2)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(np.where(change, low.astype(np.uint64) * p[place], np.uint64(0)), out=sums[1:])
    return mix((sums[tokens.ends] - sums[tokens.starts]) * q[place[tokens.starts]])


def rows_of(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, bucket, value)`` with value log(1 + count), one entry for each bucket of a document."""
    bucket, doc = token_features(buf, offsets, bits)
    key, n = np.unique((doc << bits) | bucket, return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), np.log1p(n)


def collect_features(rows, text_col: str, label_cols: list[str], bits: int = BITS):
    """Sparse rows of a bounded frame, made on the executors: ``(indptr, index, value, labels)``."""

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            index, value = [], []
            for lo, hi, buf, offsets in text_blocks(column):
                d, i, v = rows_of(buf, offsets, bits)
                cuts = np.searchsorted(d, np.arange(hi - lo + 1))
                index += [i[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                value += [v[a:b].astype(np.float32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(index, pa.binary()), pa.array(value, pa.binary()), *batch.columns[1:]], names=["i", "v", *label_cols])

    slim = rows.select(text_col, *label_cols)
    kinds = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in label_cols)
    got = slim.mapInArrow(run, f"i binary, v binary, {kinds}").collect()
    index = [np.frombuffer(r.i, np.int32) for r in got]
    indptr = np.concatenate([[0], np.cumsum([len(i) for i in index])]).astype(np.int64)
    empty = np.empty(0, np.int32)
    return (
        indptr,
        np.concatenate([*index, empty]),
        np.concatenate([*[np.frombuffer(r.v, np.float32) for r in got], empty.astype(np.float32)]),
        {c: np.array([getattr(r, c) for r in got]) for c in label_cols},
    )


def unit_rows(indptr: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Values scaled so that each row has length 1."""
    norm = np.sqrt(np.maximum(sums_by(indptr, value * value), 1e-12))
    return value / np.repeat(norm, np.diff(indptr)).astype(value.dtype)


def score_blocks(column, weights: np.ndarray, bits: int = BITS):
    """The linear score of each document of an Arrow column: weights times the unit row."""
    out = []
    for lo, hi, buf, offsets in text_blocks(column):
        d, i, v = rows_of(buf, offsets, bits)
        n = hi - lo
        norm = np.sqrt(np.maximum(np.bincount(d, v * v, n), 1e-12))
        out.append(np.bincount(d, v * weights[i], n) / norm)
    return np.concatenate(out) if out else np.empty(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Adam:
    """Plain Adam over one flat vector."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, x: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        return x - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


__all__ = ["BITS", "IS_WORD", "LOWER", "Adam", "collect_features", "rows_of", "score_blocks", "sigmoid", "token_features", "unit_rows"]
