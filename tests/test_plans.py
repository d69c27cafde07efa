"""Scale properties of the physical plans (guards against regressions)."""

from pyspark.sql import functions as F

from conftest import SF001
from __spark_entry__ import queries
from lexiframe.operators import batches as B
from lexiframe.operators.bleu import sentence_stats


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_counts_pruned_combined_and_normalised_once_in_the_jvm(spark):
    p = _plan(queries()["word_counts"](spark, SF001))
    assert "ReadSchema: struct<text:string>" in p or "struct<text:string>" in p
    assert "partial_count" in p
    assert "Python" not in p and "Arrow" not in p
    assert p.count("java_method(") == 1


def test_seeded_index_hash_partitions_without_sampling(spark):
    df = spark.range(0, 100).withColumnRenamed("id", "k")
    p = _plan(B.global_index(df, "k", seed=3))
    assert "hashpartitioning(_b" in p
    assert "rangepartitioning" not in p.lower()
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_seeded_index_acts_only_when_run(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    for n in (8, 2000):
        B.global_index(spark.range(0, 1000).withColumnRenamed("id", "k"), "k", seed=3, n_parts=n)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


def test_bleu_counts_within_rows(spark):
    pairs = spark.createDataFrame([(0, ["a", "b", "c"], [["a", "b", "d"]])],
                                  "pair_id long, hyp array<string>, refs array<array<string>>")
    p = _plan(sentence_stats(pairs))
    assert "Join" not in p and "Exchange" not in p, p


def test_fetch_is_broadcast_semi_join(spark):
    p = _plan(queries()["fetch_labeled"](spark, SF001))
    assert "LeftSemi" in p and "BroadcastHashJoin" in p
