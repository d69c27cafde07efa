"""What a worker, the driver and a row hold does not grow with the table."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiframe.functions.rows import row_slices
from lexiframe.operators import batches as B
from lexiframe.operators import bleu, bpe, bpe_training, vectors


@pytest.mark.parametrize("sizes,limit", [([], 5), ([0, 0], 5), ([3, 3, 3, 50, 1, 0, 4], 5), ([9] * 20, 18)])
def test_row_slices_cover_all_rows_within_the_limit(sizes, limit):
    cuts = list(row_slices(np.array(sizes, dtype=np.int64), limit))
    assert [i for s, e in cuts for i in range(s, e)] == list(range(len(sizes)))
    assert all(sum(sizes[s + 1:e]) < limit for s, e in cuts)


def test_encoding_goes_in_slices():
    enc = bpe.word_encoder(["[UNK]", "a", "b", "ab"], [(1, 2, 3)], ["[UNK]"], "[UNK]")
    rows = [["ab", "b"], None, [], ["aab", "x"] * 30, ["b"], [None, "a"][1:]] * 7
    words = pa.array(rows, pa.list_(pa.string()))
    ids = {"ab": [3], "b": [2], "aab": [1, 3], "x": [0], "a": [1]}
    want = [None if r is None else [i for w in r for i in ids[w]] for r in rows]
    pieces = list(bpe.encode_lists(words, enc, 8))
    assert [x for p in pieces for x in p.to_pylist()] == want
    assert len(pieces) > 5 and all(len(p.flatten()) <= 3 * 30 + 24 for p in pieces)
    assert [x for p in bpe.encode_lists(words[3:9], enc, 8) for x in p.to_pylist()] == want[3:9]
    assert [p.to_pylist() for p in bpe.encode_lists(words[:0], enc)] == [[]]


def test_the_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "_CACHED_WORDS", 10)
    enc = bpe.word_encoder(["[UNK]", "a"], [], ["[UNK]"], "[UNK]")
    for n in range(200):
        assert enc("a" * (n % 90 + 1)) == np.ones(n % 90 + 1, dtype=np.int32).tobytes()
    cache = next(c.cell_contents for c in enc.__closure__ if isinstance(c.cell_contents, dict) and "a" * 64 not in c.cell_contents
                 and all(set(k) == {"a"} and isinstance(v, bytes) for k, v in c.cell_contents.items()) and c.cell_contents)
    assert len(cache) <= 10


def test_bleu_counts_in_slices(spark, monkeypatch):
    rows = [(i, ["a", "b", "c", "a"][: i % 5], [["a", "b"], ["c"] * (i % 3)][: i % 3]) for i in range(40)] + [(40, None, None), (41, [], [])]
    df = spark.createDataFrame(rows, "pair_id long, hyp array<string>, refs array<array<string>>").coalesce(1)
    whole = sorted(map(tuple, bleu.sentence_stats(df).collect()), key=str)
    seen = spark.sparkContext.accumulator(0)
    counted = bleu.batch_stats

    def count(hyps, refs, orders):
        seen.add(1)
        return counted(hyps, refs, orders)

    monkeypatch.setattr(bleu, "_SLICE_WORDS", 8)
    monkeypatch.setattr(bleu, "batch_stats", count)
    assert sorted(map(tuple, bleu.sentence_stats(df).collect()), key=str) == whole and len(whole) == 42 * 4
    assert seen.value > 5


def test_training_fetches_only_the_rows_it_asks_for(spark, monkeypatch):
    """``collect`` of a limited plan fetches that many rows of every partition it runs."""
    frame = type(spark.range(1))
    words = spark.createDataFrame([("abab", 5), ("abc", 3), ("cab", 2), ("bcbc", 1)], "word string, n long")
    tokens = ["a", "b", "c"]
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(frame, name, lambda self, name=name: pytest.fail(f"{name} in training"))
    merges, _ = bpe_training.learn_merges(words, tokens, {t: i for i, t in enumerate(tokens)}, 6)
    assert tokens[3] == "ab" and len(merges) == 3


def test_unpad_makes_the_mask_once_a_row(spark):
    n = spark.range(3).select(F.array(F.lit(7), F.lit(8)).alias("ids"), (F.col("id") + 2).cast("int").alias("n"))
    b = n.select(B.pad_to(F.col("ids"), F.col("n"), 1).alias("ids"), B.mask_of(F.col("ids"), F.col("n")).alias("m"))
    out = b.select(B.unpad(F.col("ids"), F.col("m")).alias("k"))
    assert [r.k for r in out.collect()] == [[7, 8]] * 3
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"lambdafunction\([^,]*array_repeat", plan), plan


def test_unpad_of_odd_masks(spark):
    rows = [([1, 2, 3], [1, 0, 1]), ([1, 2], [1]), ([1], [1, 1]), ([1], None), (None, [1]), ([], []), ([1, None, 3], [1, 1, 0]), ([4, 5], [None, 1])]
    df = spark.createDataFrame(rows, "ids array<int>, m array<int>").coalesce(1)
    assert [r.k for r in df.select(B.unpad(F.col("ids"), F.col("m")).alias("k")).collect()] == \
        [[1, 3], [1], [1], [], None, [], [1, None], [5]]


def _lookup(spark):
    tokens = spark.createDataFrame([(i, i % 3 if i % 2 else 7) for i in range(300)] + [(300, None)], "pos long, token_id long")
    v = spark.createDataFrame([(i, [float(i)]) for i in range(2)] + [(7, [0.5]), (7, [1.5]), (9, [9.0]), (None, [1.0])],
                              "id long, vector array<double>")
    return vectors.lookup_vectors(tokens, v)


def test_few_vectors_are_looked_up_without_a_shuffle_of_tokens(spark, monkeypatch):
    small = _lookup(spark)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    large = _lookup(spark)
    assert "_salt" in large._jdf.queryExecution().optimizedPlan().toString()
    key = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    assert key(small) == key(large) and len(key(small)) == 301 + 150


def test_large_lookup_spreads_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    tokens = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 5000).alias("token_id"))
    v = spark.range(5000).select("id", F.array(F.lit(1.0)).alias("vector"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = sorted(r["count"] for r in vectors.lookup_vectors(tokens, v).groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    assert sum(sizes) == 60_000 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
