"""Vectorised work on the UTF-8 bytes of an Arrow string column: words, word hashes, slices by document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at a time: temporary arrays stay near the caches and memory does not follow the batch.
BLOCK = 1 << 20
#: Documents of a block at most, so that a document's place in it takes 14 bits.
BLOCK_ROWS = 1 << 14
_BASE = 0x9E3779B97F4A7C15 | 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i < n."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, BLOCK + 1)
        for key, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            out = np.empty(size, dtype=np.uint64)
            out[0], done = 1, 1
            while done < size:
                step = min(done, size - done)
                out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
            _powers[key] = out
    return _powers["p"][:n], _powers["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values; works on a copy."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def text_blocks(column: pa.Array, block: int = BLOCK, rows: int = BLOCK_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of whole documents of about ``block`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=wide)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block, "right")) - 1)
        hi = min(hi, n, lo + rows)
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """The words of a block: lower-cased bytes, starts and ends, a 64-bit hash each, and where each document's begin."""

    __slots__ = ("low", "starts", "ends", "hashes", "bounds")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = IS_WORD, lower: np.ndarray = LOWER):
        low = lower[buf]
        inside = table[low]
        n = len(low)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edge = offsets[1:-1]
            edge = edge[(edge > 0) & (edge < n)]
            before[edge] = False
            after[edge - 1] = False
        self.low = low
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        p, q = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(low.astype(np.uint64) * p[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * q[self.starts])
        self.bounds = np.searchsorted(self.starts, offsets)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def sums_by(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each ``bounds[i]:bounds[i + 1]``; empty ranges give 0."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def batches_of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only batches that have rows."""
    for batch in rows:
        if batch.num_rows:
            yield batch
