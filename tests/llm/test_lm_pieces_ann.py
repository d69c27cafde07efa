import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.llm import lm, neighbours, pieces
from lexiframe.llm.common import fold as fold_col
from lexiframe.llm.trie import EliasFano, Trie, dequantise, quantise
from tests.llm.util import LONG, docs, fold, words

SF001 = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ language model

@pytest.mark.parametrize("n,universe", [(0, 10), (1, 5), (1000, 1003), (1000, 10**12), (5000, 20), (300, 2**40)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    x = np.sort(rng.integers(0, universe, n))
    e = EliasFano.build(x, universe)
    assert (e.access(np.arange(n)) == x).all()
    q = np.r_[rng.integers(0, universe, 3000), x]
    got, inside = e.find(q), np.isin(q, x)
    assert ((got >= 0) == inside).all() and (x[got[inside]] == q[inside]).all()


def test_quantisation_error():
    x = np.linspace(-20, 0, 9999)
    assert np.abs(dequantise(quantise(x)) - x).max() < 1.6e-4


def _brute(rows, train, s2=lm.STRENGTH2, s3=lm.STRENGTH3):
    uni, bi, tri, cv, cuv = (Counter() for _ in range(5))
    tokens = [[*words(t), None] for _, t in rows]
    for (i, _), ts in zip(rows, tokens):
        if train(i):
            u = v = 0
            for w in ts:
                uni[w] += 1
                bi[v, w] += 1
                cv[v] += 1
                tri[u, v, w] += 1
                cuv[u, v] += 1
                u, v = v, w
    total, size = sum(uni.values()), len(uni)
    out = []
    for (i, _), ts in zip(rows, tokens):
        u = v = 0
        base = score = 0.0
        for w in ts:
            p1 = (uni[w] + 1) / (total + size + 1)
            p2 = (bi[v, w] + s2 * p1) / (cv[v] + s2)
            base += math.log10(p1)
            score += math.log10((tri[u, v, w] + s3 * p2) / (cuv[u, v] + s3))
            u, v = v, w
        out.append((str(i), len(ts), sum(uni[w] > 0 for w in ts), total, base, score))
    return sorted(out)


def _scored(df, train, **kw):
    return sorted((str(r[0]), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                  for r in lm.score_documents(df, train, **kw).collect())


def _same(got, want):
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert abs(g[4] - w[4]) <= 1e-6 * max(1, abs(w[4])) and abs(g[5] - w[5]) <= 5e-4 * w[1] + 1e-6


@pytest.mark.parametrize("kw", [{}, {"part_chars": 15_000, "shard_tokens": 300}])  # the latter: hot words in salts
def test_scores_equal_brute_force(spark, kw):
    df = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    got = _scored(df, fold_col(F.col("doc_id"), 7) != 2, **kw)
    want = _brute(rows, lambda i: fold(i, 7) != 2)
    _same(got, want)
    held = [x for x in want if fold(int(x[0]), 7) == 2]
    assert sum(x[5] for x in held) > sum(x[4] for x in held)  # better than the unigrams on unseen texts


def test_awkward_rows(spark):
    df = docs(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    _same(_scored(df, fold_col(F.col("doc_id"), 7) != 2), _brute(rows, lambda i: fold(i, 7) != 2))
    nothing = _scored(df, F.lit(False))
    assert all(x[3] == 0 and x[5] == 0 for x in nothing)
    assert lm.score_documents(docs(spark, []), F.lit(True)).count() == 0


def test_trie_is_a_distribution():
    rng = np.random.default_rng(4)
    tri = np.unique(rng.integers(1, 12, (300, 3)), axis=0)  # (v, u, w)
    count = rng.integers(1, 9, len(tri))
    v, u, w = tri.T.astype(np.int64)
    key, inv = np.unique(v * 100 + w, return_inverse=True)
    bc = np.bincount(inv, weights=count).astype(np.int64)
    log1 = np.log10(np.full(12, 1 / 12))
    total = np.array([bc[key // 100 == x].sum() for x in np.unique(key // 100)])
    t, path = Trie.build(v, u, w, count, key // 100, key % 100, bc, total, log1[key % 100], 3.0, 2.0, 100).mapped()
    for a in range(0, 13):
        for b in range(0, 13):
            p = 10 ** t.query(np.full(12, a), np.full(12, b), np.arange(12), log1)
            assert abs(p.sum() - 1) < 5e-3
    assert isinstance(t.tables["uvw_p"].base, np.memmap) or isinstance(t.tables["uvw_p"], np.memmap)


# ------------------------------------------------------------------ pieces

def test_samples_are_lossless_and_reproducible(spark):
    df = docs(spark)
    rows = pieces.encode_sampled(df).collect()
    assert len(rows) == df.count() and all(r.lossless for r in rows)
    vocab = pieces.Vocabulary(pieces.default_path())
    again = pieces.encode_sampled(df.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.n_ids, tuple(r.ids))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert {r.n_ids for r in rows if not pieces.decode_ids(vocab, r.ids)} == {0}
    texts = Counter((r.doc_id, r.text or "") for r in df.collect())
    assert Counter((r.doc_id, r.text) for r in pieces.decode_rows(pieces.encode_sampled(df)).collect()) == texts
    other = pieces.encode_sampled(df, seed=12).collect()
    assert sorted(map(key, rows)) != sorted(map(key, other))
    assert pieces.encode_sampled(docs(spark, [])).count() == 0


def test_draws_follow_the_lattice():
    vocab = pieces.Vocabulary(pieces.default_path())
    unit = " the"
    # all segmentations and their exact probabilities
    def paths(s):
        if not s:
            return [((), 0.0)]
        return [((vocab.piece[s[:k]][0], *rest), vocab.piece[s[:k]][1] + lp)
                for k in range(1, len(s) + 1) if s[:k] in vocab.piece for rest, lp in paths(s[k:])]
    want = {p: math.exp(lp) for p, lp in paths(unit)}
    total = sum(want.values())
    n = 40_000
    sampler = pieces.Sampler(vocab, arena_edges=100)
    flat, counts = sampler.sample([unit] * n, [str(i) for i in range(n)])
    got = Counter(tuple(x.tolist()) for x in np.split(flat, np.cumsum(counts)[:-1]))
    assert set(got) <= set(want) and len(want) > 3
    for p, w in want.items():
        share = w / total
        assert abs(got[p] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4


def test_units_fall_where_no_piece_crosses():
    vocab = pieces.Vocabulary(pieces.default_path())
    for t in ("a  b\n\nc d", LONG[:500], "x" * 300, "ab" * 200 + "\u2581\U0001F600" * 40, " ", "\n", "é\u0301 a\u2581b"):
        units = vocab.split(t)
        assert "".join(units) == t
        whole, _ = pieces.Sampler(vocab).sample([t], ["k"])
        assert pieces.decode_ids(vocab, whole.tolist()) == t


# ------------------------------------------------------------------ neighbours

def test_neighbours_recall_and_order(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in e.collect()]
    out = neighbours.nearest(e, F.col("id") % 20 == 0, shard_rows=120).collect()
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 21))
        assert all(abs(r.score - s[ids == r.vec_id][0]) < 1e-9 for r in got)
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        hits += len({r.vec_id for r in got} & set(ids[best].tolist()))
        total += 20
    assert hits / total >= 0.9


def test_neighbours_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0]
    rows = [(i, same, "x") for i in range(100)] + [(100, None, "x"), (120, [0.0, 0.0], "x"), (140, [nan, 1.0], "x"),
            (160, [inf, 1.0], "x"), (180, [None, 1.0], "x"), (None, same, "x"), (0, same, "x"), (200, [3.0, 0.0], "x"),
            (220, [1.0, 2.0, 3.0], "x"), (240, [2.0, 4.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    out = neighbours.nearest(df, F.col("id") % 20 == 0, shard_rows=30).collect()
    ok = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    ok = {i: v for i, v in ok}
    for q in {i for i in ok if i % 20 == 0}:
        want = sorted((-float(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:20]
        got = [(-r.score, r.vec_id) for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)]
        assert got == want
    assert neighbours.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_eviction_changes_no_sample():
    """An arena that is always too small gives the samples of a large one."""
    import random

    vocab = pieces.Vocabulary(pieces.default_path())
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 14))) for _ in range(400)]
    blocks = [([str(i)], [" ".join(rng.choice(words) for _ in range(150))]) for i in range(12)]
    small, large = (pieces.Sampler(vocab, arena_edges=n) for n in (2000, 10 ** 9))
    for keys, texts in blocks:
        (a, na), (b, nb) = (s.sample(texts, keys) for s in (small, large))
        assert a.tolist() == b.tolist() and na.tolist() == nb.tolist()
    assert len(small.cum) <= 2000 < len(large.cum)


def test_lm_words_are_cut_at_ascii_white_space_only(spark):
    """Other white space and letters outside A-Z stay as they are."""
    import re

    texts = ["A\x1cb\x85c d", "a\tA\x0bA\x0cA\r\nÉ é K k", " ", " ", None, "İ i"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_known) for r in lm.score_documents(docs, F.col("doc_id") != 1).collect()}
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    known = {w for i, ws in enumerate(words) if i != 1 for w in ws}
    assert got == {i: (len(ws) + 1, sum(w in known for w in ws) + 1) for i, ws in enumerate(words)}
