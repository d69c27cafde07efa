"""Quality rules: base checks, then gradient-boosted trees over document statistics.

The statistics are computed over whole texts, a batch of documents at a time in numpy.  Words are numbered by
64-bit hashes; a 5-word window is the mix of its words' hashes, so windows are equal when their hashes are
(two different windows of one text collide with a chance below 2**-40 for a million words).

The trees are trained here, in numpy on the driver, on at most ``FIT_ROWS`` labelled documents (the ones with
the smallest hash of their id): logistic loss, histogram splits, and monotonic constraints on chosen features
(the score never rises with them).  A split on a constrained feature must order its children's values, and
the bounds between them hold below, so every tree is monotone.  The forest is flattened into node arrays and
scored for a whole batch level by level.

Defined results: a null or empty text has no words, fails the base checks and is not kept; a document without
label is scored like any other; with no labels (or of one class only) the trees are empty and the base checks
decide; repeated rows are judged each, equal texts alike (so ties need no rule), though of several rows or labels of one
id the fit uses any one; texts of any length are counted whole; an empty table has an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import WORDS, texts_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
FIT_ROWS = 20_000
TREES, DEPTH, RATE, BINS = 60, 4, 0.15, 64
THRESHOLD = 0.5

#: Features in order, and the sign of the effect that is allowed (-1: more never raises the score; 0: free).
FEATURES = (("log_words", 0), ("mean_word_chars", 0), ("symbol_rate", -1), ("dup_line_rate", -1),
            ("repeat_rate", -1), ("top_word_rate", -1), ("upper_rate", -1), ("digit_rate", -1),
            ("distinct_rate", 0), ("stop_rate", 0), ("punct_end_rate", 0), ("line_words", 0))
_SYMBOLS = "#*$%&|<>"
_STOP = {"the", "of", "and", "to", "in", "is", "that", "it", "was", "for",  # English
         "der", "die", "und", "das", "von", "zu", "mit", "den", "ist", "im",  # German
         "le", "la", "les", "et", "des", "que", "est", "dans", "pour", "du",  # French
         "el", "los", "de", "que", "y", "en", "un", "por", "con", "una"}  # Spanish


def window_repeats(h: np.ndarray, owner: np.ndarray, width: int = 5) -> np.ndarray:
    """Words of each document that lie in a window of ``width`` words found twice or more in it."""
    n = len(h) - width + 1
    covered = np.zeros(len(h), dtype=bool)
    if n > 0:
        with np.errstate(over="ignore"):
            w = (owner[:n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            for i in range(width):
                w = (w ^ h[i:i + n]) * np.uint64(0xFF51AFD7ED558CCD)
                w ^= w >> np.uint64(32)
        at = np.flatnonzero(owner[:n] == owner[width - 1:])
        order = np.argsort(w[at], kind="stable")
        s = w[at][order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        for p in range(width):
            covered[at[order[twice]] + p] = True
    return covered


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Base counts ``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)`` as integers, and the
    features of ``FEATURES``, one row a text."""
    n = len(texts)
    base = np.zeros((n, 5), dtype=np.int64)
    feat = np.zeros((n, len(FEATURES)))
    ids: dict[str, int] = {}
    all_h, lens = [], []
    for i, t in enumerate(texts):
        ws = WORDS.findall(t)
        base[i, 0] = len(ws)
        base[i, 1] = sum(map(len, ws))
        base[i, 2] = sum(map(t.count, _SYMBOLS))
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        base[i, 3] = len(lines) - len(set(lines))
        lens.append(len(ws))
        if not ws:
            continue
        own = [ids.setdefault(w, len(ids)) for w in ws]
        a = np.array(own, dtype=np.int64)
        all_h.append(a)
        u, c = np.unique(a, return_counts=True)
        k, chars = len(ws), base[i, 1]
        feat[i] = (np.log1p(k), chars / k, base[i, 2] / chars, base[i, 3] / max(len(lines), 1), 0.0, c.max() / k,
                   sum(map(str.isupper, ws)) / k, sum(map(t.count, "0123456789")) / chars, len(u) / k,
                   sum(w in _STOP for w in ws) / k, sum(w[-1] in ".!?" for w in ws) / k, np.log1p(k / max(len(lines), 1)))
    if all_h:
        a = np.concatenate(all_h).astype(np.uint64)
        with np.errstate(over="ignore"):
            h = (a + np.uint64(1)) * np.uint64(0xC4CEB9FE1A85EC53)
            h ^= h >> np.uint64(29)
        owner = np.repeat(np.arange(n), lens)
        base[:, 4] = np.bincount(owner, weights=window_repeats(h, owner), minlength=n).astype(np.int64)
        feat[:, 4] = base[:, 4] / np.maximum(base[:, 0], 1)
    return base, feat


@dataclass
class Forest:
    """Flat node arrays of all trees: a leaf has feature -1.  ``left``/``right`` are node numbers."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: all rows step through all trees level by level."""
        total = np.full(len(x), self.bias)
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                down = x[np.arange(len(x)), np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(down, self.left[at], self.right[at]), at)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...], trees: int = TREES, depth: int = DEPTH,
               rate: float = RATE, bins: int = BINS, l2: float = 1.0, min_rows: int = 8) -> Forest:
    """Boosted trees on logistic loss.  Sums run over histogram bins (edges at quantiles)."""
    if len(y) == 0 or y.min() == y.max():
        one = np.zeros(0, dtype=np.int64)
        return Forest(one, np.zeros(0), one, one, np.zeros(0), one, 10.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    total = np.full(len(y), bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    def weight(g, h, lo, hi):
        return np.clip(-g / (h + l2), lo, hi)

    def gain(g, h, w):
        return -(g * w + 0.5 * (h + l2) * w * w)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
        me = node()
        gs, hs = g[rows].sum(), h[rows].sum()
        w = weight(gs, hs, lo, hi)
        value[me] = rate * w
        best = (1e-6, -1, 0, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * min_rows:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                c = code[rows, j]
                gl = np.bincount(c, weights=g[rows], minlength=len(e) + 1).cumsum()[:-1]
                hl = np.bincount(c, weights=h[rows], minlength=len(e) + 1).cumsum()[:-1]
                nl = np.bincount(c, minlength=len(e) + 1).cumsum()[:-1]
                wl, wr = weight(gl, hl, lo, hi), weight(gs - gl, hs - hl, lo, hi)
                got = gain(gl, hl, wl) + gain(gs - gl, hs - hl, wr) - gain(gs, hs, w)
                ok = (nl >= min_rows) & (len(rows) - nl >= min_rows)
                if signs[j]:
                    ok &= signs[j] * (wr - wl) >= 0
                got = np.where(ok, got, -np.inf)
                k = int(got.argmax())
                if got[k] > best[0]:
                    best = (got[k], j, k, wl[k], wr[k])
        _, j, k, wl, wr = best
        if j >= 0:
            mid = (wl + wr) / 2
            bounds = {-1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi))}[signs[j]]
            goes_left = code[rows, j] <= k
            feature[me], threshold[me] = j, edges[j][k]
            left[me] = grow(rows[goes_left], g, h, level + 1, *bounds[0])
            right[me] = grow(rows[~goes_left], g, h, level + 1, *bounds[1])
        else:
            total[rows] += rate * w
        return me

    for _ in range(trees):
        q = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(len(y)), q - y, np.maximum(q * (1 - q), 1e-6), 0, -np.inf, np.inf))
    as_int = lambda a: np.array(a, dtype=np.int64)
    return Forest(as_int(feature), np.array(threshold), as_int(left), as_int(right), np.array(value), as_int(roots), bias)


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                label: str = "quality", fit_rows: int = FIT_ROWS) -> Forest:
    """Trees from at most ``fit_rows`` labelled documents; their statistics, not their texts, come to the driver."""
    picked = (labels.select(key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull())
              .dropDuplicates([key]).orderBy(F.xxhash64(key), key).limit(fit_rows))
    rows = docs.select(key, text).join(F.broadcast(picked), key)  # bounded by fit_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, f = statistics(texts_of(b, text))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(b.column(2).to_pylist(), pa.int32()), pa.array(list(f), pa.list_(pa.float64()))],
                names=[key, "y", "f"])

    kind = rows.schema[key].dataType.simpleString()
    # a repeated id can match several rows: one of each stays, so the bound holds
    got = (rows.mapInArrow(run, f"`{key}` {kind}, y int, f array<double>").dropDuplicates([key])
           .limit(fit_rows).toPandas().sort_values(key))
    x = np.array(got["f"].tolist(), dtype=np.float64).reshape(len(got), len(FEATURES))
    return fit_forest(x, (got["y"].to_numpy() > 0).astype(np.float64), tuple(s for _, s in FEATURES))


def judge_quality(docs: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text",
                  threshold: float = THRESHOLD, min_words: int = MIN_WORDS,
                  max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """``(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality_score, kept)``."""
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, feat = statistics(texts_of(b, text))
            failed = (base[:, 0] < min_words) | (100 * base[:, 4] > max_repeat_percent * base[:, 0])
            score = forest.score(feat)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(base[:, i]) for i in range(5)], pa.array(failed), pa.array(score),
                 pa.array(~failed & (score >= threshold))],
                names=[key, *names, "base_failed", "quality_score", "kept"])

    return rows.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{x} long" for x in names)
                           + ", base_failed boolean, quality_score double, kept boolean")
