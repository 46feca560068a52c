"""Toxicity by weak supervision.

1. Voters, each of one kind: lexicons (words), short and long patterns (word beginnings of four and six bytes), shapes of tokens. Their
   entries are learned from labelled rows and grouped by the toxic rows they share; each kind and group makes a voter. A group has a
   context, a common feature (in effect a language): its voters say "toxic" where their entries are dense, "clean" where the
   context occurs without any of them, and abstain elsewhere.
2. A generative label model, fitted by EM without looking at the labels, estimates how often each voter
   says "toxic" in toxic and in clean texts that it doesn't abstain from, and from what the classes leave unexplained the voters' correlations,
   within and between kinds; the evidence of correlated voters is discounted by them. The share of toxic texts is given.
3. A linear classifier over hashed features, each as present and by its density, is trained on the model's posteriors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesops import Words, mix, powers, text_blocks
from .linear import sigmoid, token_shapes
from .shared import Scratch

#: Labelled rows that are fitted on at most: those with the smallest hash of their id.
MAX_FIT_ROWS = 12000
#: Bits of a feature; the top two say its kind.
BITS = 22
KINDS = ("word", "short", "long", "shape")
#: Features whose counts by label are told apart by less than this chi-square say nothing about the label: they are left out before anything is collected.
CHI_SQUARE = 9.0
#: The most common features, from which contexts are taken; a context covers this share of its group's toxic rows.
COMMON, COVER = 2000, 0.9
#: The context of a group that no common feature covers: every row.
ANY = -1
#: Groups of entries; an entry joins a group that shares half of its toxic rows.
GROUPS, SHARED = 16, 0.5
#: Rows by which a correlation is shrunk.
FEW = 50
#: Weight of recall against precision in the decision: a clean document lost counts twice a toxic one kept.
BETA = 0.5


def features_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, feature, count for each word of the document)``, one entry for each feature of a document."""
    w, low = Words(buf, offsets), np.uint64(64 - BITS + 2)
    p, q = powers(len(w.low) + 1)
    sums = np.zeros(len(w.low) + 1, np.uint64)
    np.cumsum(w.low.astype(np.uint64) * p[: len(w.low)], out=sums[1:])
    cut = lambda n, salt: mix((sums[np.minimum(w.ends, w.starts + n)] - sums[w.starts]) * q[w.starts] ^ np.uint64(salt))
    shapes, shape_doc = token_shapes(buf, offsets)
    kinds = [w.hashes, cut(4, 0x94D049BB133111EB), cut(6, 0x5851F42D4C957F2D), mix(shapes ^ np.uint64(0x2545F4914F6CDD1D))]
    feature = np.concatenate([(h >> low).astype(np.int64) | (k << (BITS - 2)) for k, h in enumerate(kinds)])
    doc = np.concatenate([w.doc_of()] * 3 + [shape_doc])
    key = (doc << BITS) | feature
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    of = key[first] >> BITS
    return of, key[first] & ((1 << BITS) - 1), np.diff(first, append=len(key)) / np.maximum(np.diff(w.bounds), 1)[of]


def design(row: np.ndarray, index: np.ndarray, density: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, column, value)`` for the classifier: presence, and from column 2**BITS on the density, by ``_dense``."""
    return np.concatenate([row, row]), np.concatenate([index, index + (1 << BITS)]), np.concatenate([np.ones(len(row)), _dense(density)])


def _dense(density: np.ndarray) -> np.ndarray:
    """Grows with the logarithm up to one word in twenty; more says no more."""
    return np.log1p(100 * np.minimum(density, 0.05))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class LabelModel:
    """Of voters that don't abstain: P("toxic" | toxic), P("toxic" | clean); the share of toxic texts; the voters' correlations."""

    hit: np.ndarray
    noise: np.ndarray
    prior: float
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Votes are 1 (toxic), 0 (clean) and -1 (abstains)."""
        fires = np.log(self.hit) - np.log(self.noise)
        still = np.log1p(-self.hit) - np.log1p(-self.noise)
        discount = 1.0 / (1.0 + self.correlation.sum(1))
        return sigmoid(np.log(self.prior / (1 - self.prior)) + (votes == 1) @ (fires * discount) + (votes == 0) @ (still * discount))


def fit_label_model(votes: np.ndarray, prior: float, *, rounds: int = 40) -> LabelModel:
    """EM over three-valued votes, the share of toxic texts fixed.

    Voters count as independent until EM has settled; what is left in their votes then gives their correlations. Estimated from the start,
    correlations would explain the classes away.
    """
    n, v = votes.shape
    prior = float(np.clip(prior, 1e-3, 0.999))
    if not n or not v:
        return LabelModel(np.full(v, 0.5), np.full(v, 0.5), prior, np.zeros((v, v)))
    said, yes = (votes >= 0).astype(float), (votes == 1).astype(float)
    post, model = np.where((votes == 1).any(1), 0.9, 0.01), None
    for _ in range(rounds):
        hit = (yes.T @ post + 0.5) / (said.T @ post + 1.0)
        noise = (yes.T @ (1 - post) + 0.05) / (said.T @ (1 - post) + 1.0)
        hit = np.maximum(hit, np.minimum(0.999, 1.5 * noise))  # a voter's polarity is known
        model = LabelModel(np.clip(hit, 1e-4, 0.9999), np.clip(noise, 1e-5, 0.9999), prior, np.zeros((v, v)))
        now = model.posterior(votes)
        if np.abs(now - post).max() < 1e-6:
            break
        post = now
    rest = said * (yes - post[:, None] * model.hit - (1 - post)[:, None] * model.noise)
    sd = np.sqrt(np.maximum((rest * rest).T @ said, 1e-9))  # of each voter, over the rows that the other speaks on too
    both = said.T @ said
    correlation = np.clip(rest.T @ rest / (sd * sd.T), 0, 1) * both / (both + FEW)  # shrunk where few rows tell
    correlation[correlation < 0.1] = 0
    np.fill_diagonal(correlation, 0)
    return LabelModel(model.hit, model.noise, prior, correlation)


@dataclass
class Voter:
    kind: str
    context: int
    entries: np.ndarray
    #: From this density of its entries on it votes "toxic": half the median of toxic rows that have any.
    least: float = 0.0


@dataclass
class ToxicityModel:
    index: np.ndarray
    weights: np.ndarray
    bias: float
    label_model: LabelModel | None = None

    def scores(self, column) -> np.ndarray:
        # weights of presence and of density beside each other, by feature
        features = np.unique(self.index & ((1 << BITS) - 1)).astype(np.int64)
        known, table = np.zeros(1 << BITS, np.int32), np.zeros((len(features) + 1, 2))
        known[features] = np.arange(1, len(features) + 1)
        table[known[self.index & ((1 << BITS) - 1)], (self.index >> BITS).astype(np.int64)] = self.weights
        out = []
        for lo, hi, buf, offsets in text_blocks(column):
            d, i, density = features_of(buf, offsets)
            at = known[i]
            on = at > 0
            w = table[at[on]]
            out.append(sigmoid(self.bias + np.bincount(d[on], w[:, 0] + w[:, 1] * _dense(density[on]), hi - lo)))
        return np.concatenate(out) if out else np.empty(0)


def group_entries(holds: np.ndarray) -> np.ndarray:
    """The group of each entry (strongest first); ``holds[e, r]`` tells which toxic rows hold it."""
    rows: list[np.ndarray] = []
    out = np.empty(len(holds), np.int64)
    for e, mine in enumerate(holds):
        share = [float((mine & r).sum() / mine.sum()) for r in rows]
        best = int(np.argmax(share)) if rows else -1
        if best < 0 or (share[best] < SHARED and len(rows) < GROUPS):
            rows.append(mine.copy())
            best = len(rows) - 1
        else:
            rows[best] |= mine
        out[e] = best
    return out


def learn_voters(row: np.ndarray, index: np.ndarray, density: np.ndarray, y: np.ndarray, common: np.ndarray, has: np.ndarray) -> list[Voter]:
    """Voters of features that occur far more often in toxic rows; grouped (see ``group_entries``).

    ``has[r, c]`` tells which rows hold which of the ``common`` features, from which contexts are taken.
    """
    n, n1 = len(y), max(1, int(y.sum()))
    n0 = max(1, n - int(y.sum()))
    used, at = np.unique(index, return_inverse=True)
    k1, k0 = np.bincount(at, y[row], len(used)), np.bincount(at, 1 - y[row], len(used))
    odds = np.log((k1 + 0.1) / (n1 + 0.2)) - np.log((k0 + 0.1) / (n0 + 0.2))
    # what chance makes of that many features: at least three toxic rows, and far beyond a random share of them
    good = np.flatnonzero((k1 >= 3) & (odds > np.log(4)) & (odds * np.sqrt(k1) > 4))
    if not len(good):
        return []
    good = good[np.argsort(-(odds * np.sqrt(k1))[good], kind="stable")]
    order = np.argsort(at, kind="stable")
    begin = np.searchsorted(at[order], np.arange(len(used) + 1))
    toxic = np.flatnonzero(y > 0)
    nth = np.full(n, -1)
    nth[toxic] = np.arange(len(toxic))
    holds = np.zeros((len(good), len(toxic)), bool)
    for e, g in enumerate(good):
        mine = nth[row[order[begin[g] : begin[g + 1]]]]
        holds[e, mine[mine >= 0]] = True
    of, kind = group_entries(holds), used[good] >> (BITS - 2)
    width, voters = has.mean(0), []
    for g in range(int(of.max()) + 1):
        cover = has[toxic[holds[of == g].any(0)]].mean(0)
        fit = np.flatnonzero(cover >= COVER)
        context = int(common[fit[width[fit].argmin()]]) if len(fit) else ANY
        for k, name in enumerate(KINDS):
            own = used[good[(kind == k) & (of == g)]]
            if len(own):
                v = Voter(name, context, np.sort(own))
                dense = _density(v, row, index, density, n)[toxic]
                v.least = float(np.median(dense[dense > 0])) / 2
                voters.append(v)
    return voters


def _density(v: Voter, row: np.ndarray, index: np.ndarray, density: np.ndarray, n: int) -> np.ndarray:
    on = np.isin(index, v.entries)
    return np.bincount(row[on], density[on], n)


def cast_votes(voters: list[Voter], row: np.ndarray, index: np.ndarray, density: np.ndarray, common: np.ndarray, has: np.ndarray) -> np.ndarray:
    """1 (toxic), 0 (clean) or -1 (abstains) of each voter for each row."""
    n = len(has)
    votes = np.full((n, len(voters)), -1, np.int8)
    for j, v in enumerate(voters):
        dense = _density(v, row, index, density, n)
        votes[:, j] = 0 if v.context == ANY else np.where(has[:, np.searchsorted(common, v.context)], 0, -1)
        votes[dense > 0, j] = -1
        votes[dense >= v.least, j] = 1
    return votes


def fit_classifier(row, index, value, target: np.ndarray, n: int, *, rounds: int = 1000, penalty: float = 1.0, rate: float = 0.3):
    """Logistic regression on soft targets with an L1 prior: proximal AdaGrad over the features that can leave zero.

    ``penalty`` is the prior's weight in documents: a feature whose documents the other features explain to within
    that many stays at zero, so words seen in a few documents don't get to memorise them.
    """
    share = float(np.clip(target.mean() if n else 0.0, 1e-3, 0.999))
    bias, l1 = float(np.log(share / (1 - share))), penalty / max(1, n)
    used, at = np.unique(index, return_inverse=True)
    pull = np.abs(np.bincount(at, value * (share - target)[row], len(used))) / max(1, n)
    on = pull > l1  # the others' gradient is below the prior's from the start
    keep = on[at]
    place = np.cumsum(on) - 1
    used, row, at, value = used[on], row[keep], place[at[keep]], value[keep]
    w, gw, gb = np.zeros(len(used)), np.full(len(used), 1e-8), 1e-8
    before = w
    for i in range(rounds if n else 0):
        if i % 50 == 49:
            if np.abs(w - before).max(initial=0) < 1e-3:
                break
            before = w
        g = (sigmoid(bias + np.bincount(row, value * w[at], n)) - target) / n
        grad, g_bias = np.bincount(at, value * g[row], len(used)), g.sum()
        gw += grad * grad
        gb += g_bias * g_bias
        step = rate / np.sqrt(gw)
        w = w - step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        bias -= rate / np.sqrt(gb) * g_bias
    return used[w != 0], w[w != 0].astype(np.float32), bias


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, text_col="text", id_col="doc_id", label_col="toxic", max_rows: int = MAX_FIT_ROWS) -> ToxicityModel:
    """Learns from labelled rows that are not held out, ``max_rows`` at most; null ids and labels are left out.

    Features are made and counted on the executors; the driver gets only those that the labels tell apart.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = known.select(F.col(id_col).alias("_sm_id"), F.col(label_col).cast("double").alias("_sm_y"))
    chosen = chosen.orderBy(F.md5(F.col("_sm_id").cast("string")), "_sm_id", "_sm_y").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_sm_id"), F.coalesce(text_col, F.lit("")).alias("_sm_text")).join(F.broadcast(chosen), "_sm_id")
    scratch = Scratch(docs.sparkSession, "toxicity")
    made = scratch.put(rows.select("_sm_text", "_sm_y").mapInArrow(_features, "i array<int>, v array<float>, y double"), "features")
    n, n1 = made.agg(F.count("*"), F.sum("y")).first()
    share = (n1 or 0.0) / max(1, n)
    counts = scratch.put(made.select(F.explode("i").alias("f"), "y").groupBy("f").agg(F.count("*").alias("k"), F.sum("y").alias("k1")), "counts")
    surplus = F.col("k1") - share * F.col("k")
    told = counts.filter((surplus * surplus > CHI_SQUARE * share * (1 - share) * F.col("k")) & (F.abs(surplus) > 2)).select("f")
    common = np.sort(np.array([r.f for r in counts.filter(F.col("k") < 0.95 * n).orderBy(F.desc("k"), "f").limit(COMMON).collect()], np.int32))
    told = np.sort(np.array([r.f for r in told.collect()], np.int32))
    common = np.setdiff1d(common, told)
    # of common features one bit for each row comes to the driver, of those that tell labels apart the densities
    got = made.mapInArrow(_chosen(docs.sparkSession.sparkContext.broadcast((told, common))), "i binary, v binary, c binary, y double").toArrow()
    index = np.concatenate([*[np.frombuffer(x, np.int32) for x in got.column("i").to_pylist()], np.empty(0, np.int32)])
    indptr = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got.column("i").to_pylist()])]).astype(np.int64)
    value = np.concatenate([*[np.frombuffer(x, np.float32) for x in got.column("v").to_pylist()], np.empty(0, np.float32)])
    bits = np.array([np.frombuffer(x, np.uint8) for x in got.column("c").to_pylist()], np.uint8).reshape(got.num_rows, -(-len(common) // 8))
    has = np.unpackbits(bits, axis=1, count=len(common)).astype(bool) if len(common) else np.zeros((got.num_rows, 0), bool)
    return fit_from_features(indptr, index.astype(np.int64), value, got.column("y").to_numpy().astype(float), common.astype(np.int64), has)


def _features(batches):
    for batch in batches:
        lists: list[np.ndarray] = []
        values: list[np.ndarray] = []
        for lo, hi, buf, offsets in text_blocks(batch.column(0)):
            d, i, v = features_of(buf, offsets)
            cuts = np.searchsorted(d, np.arange(1, hi - lo))
            lists += np.split(i.astype(np.int32), cuts)
            values += np.split(v.astype(np.float32), cuts)
        yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), batch.column(1)], names=["i", "v", "y"])


def _chosen(sent):
    def run(batches):
        told, common = sent.value
        for batch in batches:
            index, value, bits = [], [], []
            for x, v in zip(batch.column(0), batch.column(1), strict=True):
                i = np.asarray(x.values.to_numpy(zero_copy_only=False) if len(x) else np.empty(0), np.int32)
                on = np.isin(i, told)
                index.append(i[on].tobytes())
                value.append(np.asarray(v.values.to_numpy(zero_copy_only=False) if len(v) else np.empty(0), np.float32)[on].tobytes())
                bits.append(np.packbits(np.isin(common, i)).tobytes())
            columns = [pa.array(c, pa.binary()) for c in (index, value, bits)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(2)], names=["i", "v", "c", "y"])

    return run


def fit_from_features(indptr: np.ndarray, index: np.ndarray, density: np.ndarray, y: np.ndarray, common: np.ndarray, has: np.ndarray) -> ToxicityModel:
    n = len(y)
    if not n:
        return ToxicityModel(np.empty(0, np.int64), np.empty(0, np.float32), -5.0)
    row = np.repeat(np.arange(n), np.diff(indptr))
    voters = learn_voters(row, index, density, y, common, has)
    votes = cast_votes(voters, row, index, density, common, has)
    label_model = fit_label_model(votes, float(y.mean()))
    target = label_model.posterior(votes) if voters else np.full(n, float(y.mean()))
    row, column, value = design(row, index, density)
    used, weights, bias = fit_classifier(row, column, value, target, n)
    # the bias is put where the classifier parts the labels of the fit rows best (by F-measure, precision weighing BETA), so that 0.5 is the decision
    table = np.zeros(2 << BITS)
    table[used] = weights
    z = np.bincount(row, table[column] * value, n)
    order = np.argsort(-z, kind="stable")
    hard = y[order] > 0.5
    if hard.any() and len(used):
        found = np.cumsum(hard)
        f1 = (1 + BETA**2) * found / (np.arange(1, n + 1) + BETA**2 * hard.sum())
        last = np.append(z[order][1:] != z[order][:-1], True)  # ties stay together
        f1 = np.where(last, f1, -1)
        k = int(np.argmax(f1))
        bias = -float((z[order][k] + (z[order][k + 1] if k + 1 < n else z[order][k] - 1)) / 2)
    return ToxicityModel(used, weights, bias, label_model)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` plus ``toxic_score`` (0 to 1) and ``toxic_predicted`` (1 from 0.5 on).

    Only the text is an input of a score. Null and empty texts get the score of the bias; without any label all texts get
    a low one. One row for each input row, whole texts, nothing is shuffled.
    """
    docs = docs.drop("toxic_score", "toxic_predicted")
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            score = m.scores(batch.column(at))
            more = [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "toxic_score", "toxic_predicted"])

    fields = [T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_predicted", T.IntegerType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
