"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents; everything else the classifier sees is unlabelled text.  A linear
model is trained by full-batch Adagrad on the risk ``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))``
(logistic loss); while the bracket is not positive only the positives pull, as in the non-negative estimator,
so the model cannot buy risk by overfitting the unlabelled set.  Soft thresholding keeps only
features that carry weight.

A document is the set of its character n-grams (lower-cased, hashed to ``KEY_BITS`` bits, wide enough that no long text
meets a weight by collision), so inflected and suffixed forms of a word share features, each at the levels
``LEVELS`` of its number of occurrences: a long clean text meets a toxic stem once by chance, a toxic one again and again
in several forms.  The model is a sorted table of the keys that carry weight.  Whole texts are hashed in numpy; only
n-grams with a weight go on to the per-document counts, which makes scoring sparse.

The fit uses a bounded sample (documented parameters): the ``fit_positives`` training positives and
``fit_unlabelled`` training documents with the smallest hash of their id.  Their texts stay in the tasks: Spark counts
which features enough positives have, and how many of the others; only the features that pass the lift come to the
driver, of each sampled document.  The class
prior is the share of toxic labels among training rows unless given (at least 0.001, at most 0.999).

Defined results: a null or empty text gets the score of the empty feature set; without a positive example
every score is 0; documents without label are scored like any others; an id with several labels is toxic if one
of them is, and of several rows of an id the fit uses the one whose text has the smallest hash, while each is scored;
equal texts have equal scores, so ties need no rule; an empty table has an empty result; texts of any length are read
whole; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import materialize, texts_of
from lexiframe.llm.langid import grams_of

KEY_BITS = 51  # all that the n-gram hash gives
_NEAR_BITS = 20  # keys are looked up only where a table of their low bits has a mark
ORDERS = (5,)
LEVELS = (1, 2, 3, 5)  # occurrences from which a level's feature is there; a feature is ``n-gram << 2 | level``
FIT_POSITIVES, FIT_UNLABELLED = 2_000, 6_000
STEPS, RATE, SHRINK = 400, 0.3, 2e-4
# A feature needs this many positives, and this lift over the negatives.
MIN_POSITIVES, MIN_LIFT = 3, 20.0


def text_features(texts: list[str], bits: int = KEY_BITS, orders: tuple[int, ...] = ORDERS) -> list[np.ndarray]:
    """Hashed n-grams of each text with their levels; a space at both ends marks the text's edge words."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for g, o in grams_of([f" {t} " if t else "" for t in texts], orders, bits):
        cut = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else []
        for own, part in zip(o[cut] if len(o) else (), np.split(g, cut[1:]) if len(o) else ()):
            out[own].append(part)
    none = np.zeros(0, np.int64)
    return [_levelled(np.concatenate(x)) if x else none for x in out]


def _levelled(grams: np.ndarray) -> np.ndarray:
    found, times = np.unique(grams, return_counts=True)
    return np.sort(np.concatenate([(found[times >= t] << 2) | level for level, t in enumerate(LEVELS)]))


def _found(keys: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which n-grams are among the ascending ``keys``, and where those stand."""
    if not len(keys):
        return np.zeros(len(grams), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
    hit = keys[at] == grams
    return hit, at[hit]


@dataclass
class ToxicModel:
    """``weights[i]`` belongs to the feature ``keys[i]``; the keys ascend."""

    weights: np.ndarray
    bias: float
    prior: float
    keys: np.ndarray
    bits: int = KEY_BITS
    orders: tuple[int, ...] = ORDERS

    def __post_init__(self):
        self.grams, row = np.unique(self.keys >> 2, return_inverse=True)
        own = np.zeros((len(self.grams), len(LEVELS)))
        own[row, self.keys & 3] = self.weights
        self.summed = own.cumsum(axis=1)  # the weight of an n-gram that reached a level
        self.near = np.zeros(1 << _NEAR_BITS, bool)
        self.near[self.grams & ((1 << _NEAR_BITS) - 1)] = True

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores in [0, 1] of a batch of texts."""
        z = np.full(len(texts), self.bias)
        n, low = len(self.grams), (1 << _NEAR_BITS) - 1
        places, times = [], []
        for g, o in grams_of([f" {t} " if t else "" for t in texts], self.orders, self.bits):
            at = self.near[g & low]
            if at.any():
                hit, col = _found(self.grams, g[at])
                p, c = np.unique(o[at][hit] * n + col, return_counts=True)
                places.append(p)
                times.append(c)
        if places:  # a text can come in several parts
            p, which = np.unique(np.concatenate(places), return_inverse=True)
            c = np.bincount(which, weights=np.concatenate(times), minlength=len(p))
            level = np.searchsorted(LEVELS, c, side="right") - 1
            z += np.bincount(p // n if n else p, weights=self.summed[p % n, level] if n else None, minlength=len(texts))
        return _sigmoid(z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk_gradient(pz: np.ndarray, uz: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the risk by the scores of the positives and of the unlabelled (the bracket's only while positive)."""
    sp, su = _sigmoid(pz), _sigmoid(uz)
    # logistic loss: l(+) = log(1 + e^-z), l(-) = log(1 + e^z); d l(+) = s - 1, d l(-) = s
    gp, gu = prior * (sp - 1) / len(pz), np.zeros(len(uz))
    if (np.logaddexp(0, uz).mean() if len(uz) else 0.0) > prior * np.logaddexp(0, pz).mean():
        gp, gu = gp - prior * sp / len(pz), su / len(uz)
    return gp, gu


def lift_of(in_pos: np.ndarray, in_unl: np.ndarray, n_pos: int, n_unl: int, prior: float) -> np.ndarray:
    """How much more often positives have a feature than negatives (the unlabelled less the prior's share of positives)."""
    in_neg = np.maximum(in_unl - prior * n_unl * in_pos / max(n_pos, 1), 0) / (1 - prior)
    return (in_pos / max(n_pos, 1)) / ((in_neg + 0.5) / (n_unl + 1))


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, bits: int | None = None,
             steps: int = STEPS, rate: float = RATE, shrink: float = SHRINK, min_positives: int = MIN_POSITIVES,
             min_lift: float = MIN_LIFT) -> ToxicModel:
    """Train on feature sets with the non-negative risk estimator.  Features that are not clearly more frequent
    among positives than among negatives (unlabelled documents less the prior's share of positives) get no
    weight, whatever share of the documents is positive.  The model holds the features with a weight; given
    ``bits``, features are numbers below ``2 ** bits`` and the model holds them all."""
    every = np.arange(1 << bits if bits else 0)
    if not pos:
        return ToxicModel(np.zeros(len(every)), -40.0, prior, every, bits or KEY_BITS)
    # only what positives have can get a weight
    keys, in_pos = np.unique(np.concatenate(pos), return_counts=True)
    common = in_pos >= min(len(pos), min_positives)
    keys, in_pos = keys[common], in_pos[common]
    pos, unl = ([_found(keys, r)[1] for r in rows] for rows in (pos, unl))
    in_unl = np.bincount(np.concatenate([*unl, np.zeros(0, np.int64)]), minlength=len(keys))
    keep = lift_of(in_pos, in_unl, len(pos), len(unl), prior) >= min_lift
    column, chosen = np.cumsum(keep) - 1, np.flatnonzero(keep)
    dense = [[column[r[keep[r]]] for r in rows] for rows in (pos, unl)]
    d = len(chosen)
    w, g2, b, b2 = np.zeros(d), np.full(d, 1e-8), float(np.log(prior / (1 - prior))), 1e-8

    def flat(rows):
        return (np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64),
                np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows))

    (pf, p_own, n_p), (uf, u_own, n_u) = map(flat, dense)
    for _ in range(steps):
        pz = np.bincount(p_own, weights=w[pf], minlength=n_p) + b
        uz = np.bincount(u_own, weights=w[uf], minlength=n_u) + b
        gp, gu = risk_gradient(pz, uz, prior)
        grad = np.bincount(pf, weights=gp[p_own], minlength=d) + np.bincount(uf, weights=gu[u_own], minlength=d)
        g2 += grad ** 2
        step = rate / np.sqrt(g2)
        w -= step * grad
        gb = gp.sum() + gu.sum()
        b2 += gb * gb
        b -= rate * gb / np.sqrt(b2)
        w = np.sign(w) * np.maximum(np.abs(w) - step * shrink, 0)
    if bits:
        weights = np.zeros(len(every))
        weights[keys[chosen]] = w
        return ToxicModel(weights, float(b), prior, every, bits)
    return ToxicModel(w[w != 0], float(b), prior, keys[chosen][w != 0])


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text",
                 label: str = "toxic", prior: float | None = None, fit_positives: int = FIT_POSITIVES,
                 fit_unlabelled: int = FIT_UNLABELLED) -> ToxicModel:
    """Fit on training rows (``train`` is a condition on the key).  Labels are used for the positives and the
    prior only; the unlabelled set is drawn from all training documents, labelled or not."""
    known = (labels.select(key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull() & train)
             .groupBy(key).agg((F.max(label) > 0).cast("int").alias("_y")))
    if prior is None:
        r = known.agg(F.avg(F.col("_y").cast("double")).alias("p")).first()["p"]
        prior = min(max(float(r or 0.0), 1e-3), 1 - 1e-3)
    order = (F.xxhash64(key), key)
    p_ids = known.where(F.col("_y") > 0).select(key).orderBy(*order).limit(fit_positives)
    u_ids = (docs.where(F.col(key).isNotNull() & train).select(key).distinct().orderBy(*order).limit(fit_unlabelled))
    ids = p_ids.select(key, F.lit(1).alias("p")).unionByName(u_ids.select(key, F.lit(0).alias("p")))
    ids = ids.groupBy(key).agg(F.max("p").alias("p"), F.min("p").alias("u"))
    rows = docs.select(F.col(key), F.col(text).alias("_t")).join(F.broadcast(ids), key)  # bounded by the two sample sizes
    # of several rows of an id the one whose text has the smallest hash
    rows = rows.groupBy(key, "p", "u").agg(F.min(F.struct(F.xxhash64("_t").alias("h"), "_t")).alias("_m"))
    sample = materialize(rows.select("p", "u", F.col("_m._t").alias("t")), "toxicity-sample")
    def counts(rows: DataFrame, among) -> DataFrame:
        """How many of the documents have each feature (of those in the broadcast ``among``)."""
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = text_features(texts_of(b, "t"))
                keys, n = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
                if among is not None:
                    hit = _found(among.value, keys)[0]
                    keys, n = keys[hit], n[hit]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["k", "n"])

        return rows.select("t").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))

    # what enough sampled positives have, then what they have clearly more often than the others
    n_pos, n_unl = [int(v or 0) for v in sample.agg(F.sum("p"), F.count_if(F.col("u") == 0)).first()]
    sc = docs.sparkSession.sparkContext
    common = (counts(sample.where("p = 1"), None).where(F.col("n") >= min(n_pos, MIN_POSITIVES)).orderBy("k").toPandas())
    keys, in_pos = common["k"].to_numpy(dtype=np.int64), common["n"].to_numpy(dtype=np.int64)
    others = counts(sample.where("u = 0"), sc.broadcast(keys)).toPandas()
    in_unl = np.zeros(len(keys), dtype=np.int64)
    in_unl[_found(keys, others["k"].to_numpy(dtype=np.int64))[1]] = others["n"].to_numpy(dtype=np.int64)
    shared = sc.broadcast(keys[lift_of(in_pos, in_unl, n_pos, n_unl, prior) >= MIN_LIFT])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        for b in batches:
            found = [f[_found(keys, f)[0]] for f in text_features(texts_of(b, "t"))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f.tobytes() for f in found], pa.binary())],
                                             names=["p", "u", "f"])

    pos, unl = [], []
    for r in sample.select("p", "u", "t").mapInArrow(reduce, "p int, u int, f binary").orderBy("p", "u", "f").toLocalIterator():
        f = np.frombuffer(bytes(r["f"]), dtype=np.int64)
        if r["p"]:
            pos.append(f)
        if not r["u"]:
            unl.append(f)
    return fit_nnpu(pos, unl, prior)


def score_toxicity(docs: DataFrame, model: ToxicModel, key: str = "doc_id", text: str = "text",
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, *keep, score, predicted)`` for every row; ``predicted`` is 1 from 0.5 on."""
    rows = docs.select(key, text, *keep)
    # the features with a weight, as plain arrays: workers need not have this package
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.prior, model.keys, model.bits, model.orders))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicModel(*shared.value)
        for b in batches:
            s = model.score(texts_of(b, text))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[b.column(2 + i) for i in range(len(keep))], pa.array(s, pa.float64()),
                 pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=[key, *keep, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return rows.mapInArrow(run, kinds + ", score double, predicted int")
