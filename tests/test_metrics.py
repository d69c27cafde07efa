import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexiframe.functions.scores import argmax, cross_entropy, softmax
from lexiframe.operators import metrics as M
from lexiframe.operators.bleu import corpus_bleu
from lexiframe.operators.vectors import positional_table


def test_mean_of_means_and_zero_mask(spark):
    rows = [(0, 1.0, 1), (0, 1.0, 1), (0, 1.0, 1), (1, 5.0, 1), (2, 9.0, 0)]
    df = spark.createDataFrame(rows, "batch_id long, loss double, mask int")
    b = M.batch_losses(df)
    got = {r["batch_id"]: r["batch_loss"] for r in b.collect()}
    assert got[0] == 1.0 and got[1] == 5.0 and got[2] is None
    e = M.evaluation_loss(b).first()
    assert e["eval_loss"] == 3.0
    assert e["token_weighted_loss"] == 2.0
    assert e["n_empty_batches"] == 1
    assert abs(e["perplexity"] - math.exp(3.0)) < 1e-12


def test_cross_entropy_matches_numpy(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(20, 8)) * 3
    y = rng.integers(0, 8, size=20)
    df = spark.createDataFrame([(z[i].tolist(), int(y[i])) for i in range(20)], "z array<double>, y int")
    out = df.select(cross_entropy(F.col("z"), F.col("y")).alias("a"),
                    cross_entropy(F.col("z"), F.col("y"), 0.1).alias("b"),
                    argmax(F.col("z")).alias("c"), softmax(F.col("z")).alias("d")).collect()
    for i, r in enumerate(out):
        lse = np.log(np.exp(z[i] - z[i].max()).sum()) + z[i].max()
        logp = z[i] - lse
        assert abs(r["a"] + logp[y[i]]) < 1e-9
        smooth = 0.9 * (-logp[y[i]]) + 0.1 * (-logp.mean())
        assert abs(r["b"] - smooth) < 1e-9
        assert r["c"] == int(np.argmax(z[i]))
        assert np.allclose(r["d"], np.exp(logp))


def test_positional_pos0(spark):
    rows = positional_table(spark, 2, 6).where("pos = 0").orderBy("dim").collect()
    assert [r["value"] for r in rows] == [0.0, 1.0, 0.0, 1.0, 0.0, 1.0]


def _ngrams(t, n):
    return Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))


def _brute_bleu(pairs):
    """Corpus BLEU written out directly (one loop per hypothesis)."""
    num, den = Counter(), Counter()
    c = r = 0
    for hyp, refs in pairs:
        for n in range(1, 5):
            h = _ngrams(hyp, n)
            mx = Counter()
            for ref in refs:
                for g, k in _ngrams(ref, n).items():
                    mx[g] = max(mx[g], k)
            num[n] += sum(min(k, mx[g]) for g, k in h.items())
            den[n] += max(1, sum(h.values()))
        c += len(hyp)
        r += min((len(x) for x in refs), key=lambda L: (abs(L - len(hyp)), L))
    if num[1] == 0:
        return 0.0
    bp = 1.0 if c > r else (0.0 if c == 0 else math.exp(1 - r / c))
    s = sum(0.25 * math.log(num[n] / den[n] if num[n] else 2.2250738585072014e-308) for n in range(1, 5))
    return bp * math.exp(s)


def test_bleu_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = list("abcde")
    for trial in range(3):
        pairs = []
        for _ in range(12):
            hyp = [rnd.choice(vocab) for _ in range(rnd.randint(0, 9))]
            refs = [[rnd.choice(vocab) for _ in range(rnd.randint(1, 9))] for _ in range(rnd.randint(1, 3))]
            pairs.append((hyp, refs))
        df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)],
                                   "pair_id long, hyp array<string>, refs array<array<string>>")
        got = corpus_bleu(df).first()["bleu"]
        want = _brute_bleu(pairs)
        assert abs(got - want) <= 1e-12 * max(1.0, abs(want)), (trial, got, want)


def test_bleu_identity(spark):
    df = spark.createDataFrame([(0, ["a", "b", "c", "d", "e"], [["a", "b", "c", "d", "e"]])],
                               "pair_id long, hyp array<string>, refs array<array<string>>")
    assert corpus_bleu(df).first()["bleu"] == 1.0


def test_score_batches_hook(spark):
    import pandas as pd

    df = spark.createDataFrame([(0, 1, [4, 5], [1, 1]), (0, 0, [6, 7], [1, 0]), (1, 0, [8, 9], [1, 1])],
                               "batch_id long, slot int, labels array<int>, labels_mask array<int>")

    def uniform(pdf):
        rows = []
        for _, r in pdf.iterrows():
            for p, (lab, m) in enumerate(zip(r["labels"], r["labels_mask"])):
                rows.append((r["batch_id"], r["slot"], p, math.log(10.0), int(m)))
        return pd.DataFrame(rows, columns=["batch_id", "slot", "pos", "loss", "mask"])

    scored = M.score_batches(df, uniform, "batch_id long, slot int, pos int, loss double, mask int")
    b = {r["batch_id"]: r["batch_loss"] for r in M.batch_losses(scored).collect()}
    assert abs(b[0] - math.log(10.0)) < 1e-12 and abs(b[1] - math.log(10.0)) < 1e-12


def test_bleu_single_reference_path_matches_brute_force(spark):
    rnd = random.Random(11)
    vocab = list("abcd")
    pairs = [([rnd.choice(vocab) for _ in range(rnd.randint(0, 10))],
              [[rnd.choice(vocab) for _ in range(rnd.randint(1, 10))]]) for _ in range(15)]
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)],
                               "pair_id long, hyp array<string>, refs array<array<string>>")
    got = corpus_bleu(df).first()["bleu"]
    want = _brute_bleu(pairs)
    assert abs(got - want) <= 1e-12 * max(1.0, abs(want))
