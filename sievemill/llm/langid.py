"""Language by rank-order profiles (out-of-place distance of n-grams).

A profile lists a language's most frequent letter n-grams (one to three letters, inside words, with a mark at either end)
by rank. A document's own most frequent n-grams are ranked the same way, and each language's distance is
the sum of how far its ranks are out of place; an n-gram that a profile lacks counts as the full length.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .bytesops import text_blocks

#: N-grams of a profile and of a document that are ranked; the feature of the method, not a cap on texts.
PROFILE = 400
#: Languages that one pass compares with (each about 8 KB of a broadcast); more languages take more passes.
LANGUAGES = 2000
#: Groups of a language's n-grams that are ranked on their own before the best of all are.
SALTS = 64
#: Bits of a letter's number, and documents of a block, so that a document and three letters fit 63 bits.
LETTER, ROWS = 18, 1 << 9
MARK = 1


@cache
def _letters() -> np.ndarray:
    """The number of each code point that is a letter or a combining mark, from 2; 0 for all others."""
    out = np.zeros(sys.maxunicode + 1, np.int32)
    kinds = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] in "LM"]
    out[kinds] = np.arange(2, len(kinds) + 2)
    assert len(kinds) + 2 < 1 << LETTER
    return out


def _points(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of a block's code points, and where each document's begin."""
    raw = buf.tobytes()
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    first = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    bounds = first[offsets]
    if len(points) != bounds[-1]:  # bytes that are no UTF-8: each document by itself
        parts = [np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le"), "<u4") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        points, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return _letters()[points], bounds


def ngrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(code, document)`` of each n-gram of lower-cased text; a code is its letters' numbers, the last one lowest."""
    docs = len(offsets) - 1
    text, bounds = _points(buf, offsets)
    n = len(text)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    letter = text > 0
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    # each document gets a mark before it; runs of other characters become one mark
    gap = ~letter
    gap[1:] &= letter[:-1]
    gap[0] = False
    gap[bounds[:-1][bounds[:-1] < n]] = False
    keep = letter | gap
    owner = doc[keep]
    count = np.bincount(owner, minlength=docs)
    total = int(keep.sum()) + 2 * docs
    stream, who = np.full(total, MARK, np.int64), np.repeat(np.arange(docs), count + 2)
    place = np.arange(total - 2 * docs) + 2 * owner + 1
    stream[place] = np.where(letter, text, MARK)[keep]
    inner = stream != MARK
    ones = np.flatnonzero(inner)
    two = np.flatnonzero((inner[:-1] | inner[1:]) & (who[:-1] == who[1:]))
    three = np.flatnonzero(inner[1:-1] & (who[:-2] == who[2:]))
    codes = [
        stream[ones],
        (stream[two] << LETTER) | stream[two + 1],
        (stream[three] << 2 * LETTER) | (stream[three + 1] << LETTER) | stream[three + 2],
    ]
    return np.concatenate(codes), np.concatenate([who[ones], who[two], who[three]])


def counted(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, code, count)`` of a block of at most ``ROWS`` documents."""
    code, doc = ngrams(buf, offsets)
    key = (doc << 3 * LETTER) | code
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] >> 3 * LETTER, key[first] & ((1 << 3 * LETTER) - 1), np.diff(first, append=len(key))


@dataclass
class Profiles:
    """Languages in order; their n-grams by code, with the place of their language and their rank in it."""

    languages: list[str]
    codes: np.ndarray
    place: np.ndarray
    rank: np.ndarray

    def part(self, first: int, last: int) -> Profiles:
        """The profiles of ``languages[first:last]``."""
        on = (self.place >= first) & (self.place < last)
        return Profiles(self.languages[first:last], self.codes[on], self.place[on] - first, self.rank[on])


def learn_profiles(docs: DataFrame, *, text_col="text", lang_col="lang", size: int = PROFILE) -> Profiles:
    """Profiles of the languages in ``docs``, from every row with a language; ties in count go to the smaller n-gram.

    N-grams are summed within each batch before they are shuffled, so a hot language sends no more rows than
    there are n-grams. They are ranked in ``SALTS`` groups first and the best of those then, so no task ranks more than ``SALTS * size`` rows
    of a language at the end. The result has ``size`` rows a language. A null text has no n-grams; a language whose texts have none is not learned.
    """

    def run(batches):
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            number = langs.indices.to_numpy()
            total: list[np.ndarray] = []
            for lo, hi, buf, offsets in text_blocks(batch.column(0), rows=ROWS):
                d, c, n = counted(buf, offsets)
                total.append(np.stack([number[lo:hi][d], c, n]))
            if total:
                lang, code, n = np.concatenate(total, 1)
                order = np.lexsort((code, lang))
                lang, code, n = lang[order], code[order], n[order]
                first = np.flatnonzero((np.diff(lang, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
                if len(first):
                    n = np.add.reduceat(n, first)
                    yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[first])), pa.array(code[first]), pa.array(n)], names=["lang", "code", "n"])

    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.lower(F.coalesce(text_col, F.lit(""))).alias("t"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.col("code")]
    some = counts.withColumn("salt", F.pmod(F.xxhash64("code"), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= size)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= size)
    got = ranked.select("lang", "code", "rank").toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    number = {x: i for i, x in enumerate(languages)}
    place = np.array([number[x] for x in got.column("lang").to_pylist()], np.int64)
    codes, rank = got.column("code").to_numpy(), got.column("rank").to_numpy().astype(np.int64) - 1
    order = np.lexsort((place, codes))
    return Profiles(languages, codes[order], place[order], rank[order])


def _distances(column, model: Profiles, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(document x language distances, n-grams ranked)``."""
    dist, used, k = [], [], len(model.languages)
    for lo, hi, buf, offsets in text_blocks(column, rows=ROWS):
        d, c, n = counted(buf, offsets)
        order = np.lexsort((c, -n, d))
        d, c = d[order], c[order]
        begin = np.searchsorted(d, np.arange(hi - lo))
        rank = np.arange(len(d)) - begin[d]
        top = rank < size
        d, c, rank = d[top], c[top], rank[top]
        m = np.bincount(d, minlength=hi - lo)
        # all n-grams at the full length, less what those in a profile are nearer
        first, last = np.searchsorted(model.codes, c), np.searchsorted(model.codes, c, "right")
        times = last - first
        at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        near = size - np.abs(model.rank[at] - np.repeat(rank, times))
        gain = np.bincount(np.repeat(d, times) * k + model.place[at], near, (hi - lo) * k)
        dist.append((m * size)[:, None] - gain.reshape(hi - lo, k))
        used.append(m)
    return np.concatenate(dist), np.concatenate(used)


def predict_language(docs: DataFrame, model: Profiles, *, text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """Every column of ``docs`` plus ``lang_pred`` and ``lang_score``.

    The score is one less the winner's distance as a share of the largest possible. Ties go to the language that sorts
    first. ``und`` with score 0 where the text is null or has no letter, or when no language was learned. Whole texts are read;
    one row for each input row, repeated rows alike, nothing is shuffled. Columns named ``lang_pred`` or ``lang_score`` are replaced; others pass through,
    whatever their names. Models of more than ``LANGUAGES`` languages are compared in several passes that carry the best so far.
    """
    docs = docs.drop("lang_pred", "lang_score")
    context, width = docs.sparkSession.sparkContext, len(docs.columns)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    more = [T.StructField(c, k) for c, k in (("_sm_low", T.StringType()), ("_sm_has", T.BooleanType()))]
    slim = docs.select("*", F.lower(F.coalesce(text_col, F.lit(""))).alias("_sm_low"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_sm_has"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("lang_score"))
    starts = list(range(0, max(1, len(model.languages)), LANGUAGES))

    def step(sent, last: bool):
        def run(batches):
            m = sent.value
            for batch in batches:
                columns, names = batch.columns, batch.schema.names
                if len(m.languages) and batch.num_rows:
                    dist, used = _distances(columns[width], m, size)
                    best = dist.argmin(1)
                    score = np.clip(1 - dist[np.arange(batch.num_rows), best] / np.maximum(used * size, 1), 0, 1)
                    before, kept = columns[width + 3].to_numpy(), columns[width + 2]
                    old = np.array([x != "und" for x in kept.to_pylist()])
                    won = np.array(columns[width + 1].to_pylist(), bool) & (used > 0) & (~old | (score > before))
                    pred = pa.array([m.languages[b] if w else x for b, w, x in zip(best.tolist(), won.tolist(), kept.to_pylist(), strict=True)], pa.string())
                    columns = [*columns[: width + 2], pred, pa.array(np.where(won, score, before))]
                if last:
                    columns, names = [*columns[:width], *columns[width + 2 :]], [*names[:width], *names[width + 2 :]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return run

    for first in starts:
        sent, last = context.broadcast(model.part(first, first + LANGUAGES)), first == starts[-1]
        slim = slim.mapInArrow(step(sent, last), T.StructType([*docs.schema.fields, *([] if last else more), *fields]))
    return slim
