"""Skew-split look-up, the resident scorer, n-gram statistics against plain forms, normalisation of all characters."""

import random
import unicodedata
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiframe.functions.text import normalize
from lexiframe.operators.batches import pad_batches
from lexiframe.operators.bleu import batch_stats
from lexiframe.operators.metrics import score_batches
from lexiframe.operators.vectors import lookup_vectors


def test_lookup_with_a_hot_id(spark):
    rng = random.Random(3)
    ids = [7] * 4000 + [rng.randint(0, 500) for _ in range(6000)] + [None] * 50
    tokens = spark.createDataFrame([(i, t) for i, t in enumerate(ids)], "pos long, token_id long")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(400)] + [(3, [9.0, 9.0])], "id long, vector array<double>")
    got = lookup_vectors(tokens, vectors)
    assert got.columns == ["pos", "token_id", "vector"]
    want = Counter()
    for p, t in enumerate(ids):
        for v in ([[float(t), 1.0]] if t is not None and t < 400 else [None]) + ([[9.0, 9.0]] if t == 3 else []):
            want[(p, t, tuple(v) if v else None)] += 1
    assert Counter((r.pos, r.token_id, tuple(r.vector) if r.vector else None) for r in got.collect()) == want


def test_no_task_has_the_hot_id_alone(spark):
    """With one id a third of all tokens, no partition of the look-up has over three times the median."""
    tokens = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 5000).alias("token_id"))
    vectors = spark.range(5000).select("id", F.array(F.lit(1.0)).alias("vector"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = sorted(r["count"] for r in lookup_vectors(tokens, vectors).groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 60_000 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("dealt", [False, True])
def test_resident_scorer_sees_whole_batches(spark, dealt):
    rows = [(b, s, [b, s]) for b in range(40) for s in range(b % 7 + 1)]
    df = spark.createDataFrame(rows, "batch_id long, slot int, ids array<int>").repartition(6)
    if dealt:
        df = pad_batches(df, ["ids"], 0, by_batch=True)

    def load():
        calls = []  # one list a task

        def score(pdf):
            calls.append(1)
            assert pdf["batch_id"].nunique() == 1 and list(pdf["slot"]) == list(range(len(pdf)))
            return pd.DataFrame({"batch_id": pdf["batch_id"], "n": len(pdf), "call": len(calls)})

        return score

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # batches are cut by frames too
    try:
        got = score_batches(df, load, "batch_id long, n long, call long", resident=True, dealt=dealt).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter(r.batch_id for r in got) == Counter(b for b, _, _ in rows)
    assert all(r.n == r.batch_id % 7 + 1 for r in got) and max(r.call for r in got) > 1


def test_dealt_batches_add_no_exchange(spark):
    df = spark.createDataFrame([(b, s, [b]) for b in range(9) for s in range(3)], "batch_id long, slot int, ids array<int>")
    plan = score_batches(pad_batches(df, ["ids"], 0, by_batch=True), lambda pdf: pdf[["batch_id"]], "batch_id long", dealt=True)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def plain_stats(hyp, refs, orders):
    out = []
    for n in range(1, orders + 1):
        grams = lambda x: Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1))
        best = Counter()
        for r in refs:
            best |= grams(r)
        out.append(sum(min(c, best[g]) for g, c in grams(hyp).items()))
    return out


def test_batch_statistics_equal_plain_counts():
    rng = random.Random(1)
    text = lambda: [rng.choice("abc") for _ in range(rng.randint(0, 9))]
    hyps = [text() for _ in range(60)] + [None, [], ["z"] * 4]
    refs = [[text() for _ in range(rng.randint(0, 3))] for _ in range(60)] + [None, [[]], [["z"] * 2, None]]
    kind = pa.list_(pa.string())
    for h, r in ((hyps, refs), (hyps[:1], refs[:1]), ([], []), ([[]], [[]])):
        num, den, near, lens = batch_stats(pa.array(h, kind), pa.array(r, pa.list_(kind)), 4)
        for i in range(len(h)):
            hyp, own = h[i] or [], [x or [] for x in r[i] or []]
            assert num[i].tolist() == plain_stats(hyp, own, 4)
            assert den[i].tolist() == [max(1, len(hyp) - k) for k in range(4)]
            assert near[i] == min((len(x) for x in own), key=lambda k: (abs(k - len(hyp)), k), default=None) and lens[i] == len(hyp)


def test_all_characters_are_normalised_as_by_the_standard_tables(spark):
    """Every assigned code point between letters, but for marks newer than the JVM's tables; no Python worker in the plan."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    df = spark.createDataFrame([(c, f"x{chr(c)}y") for c in points], "c int, t string").select("c", normalize(F.col("t")).alias("t"))

    def plain(t):
        t = unicodedata.normalize("NFD", t).replace("Σ", "σ").lower()
        return "".join(ch for ch in t if unicodedata.category(ch)[0] != "M")

    marks = spark.createDataFrame([(c, chr(c)) for c in points if unicodedata.category(chr(c))[0] == "M"], "c int, t string")
    newer = {r.c for r in marks.where(~F.col("t").rlike(r"\p{M}")).collect()}
    assert len(newer) < 200
    assert {r.c for r in df.collect() if r.t != plain(f"x{chr(r.c)}y")} <= newer
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_normalise_null_and_long(spark):
    long = "É" * 200_000 + "Σ"
    got = spark.createDataFrame([(None,), ("",), (long,), ("ΟΔΟΣ",)], "t string").select(normalize(F.col("t"))).collect()
    assert [r[0] for r in got] == [None, "", "e" * 200_000 + "σ", "οδοσ"]
