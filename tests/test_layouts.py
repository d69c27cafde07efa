"""Numbered layout, replaced datasets, as-of pairing, marked streams, run records, column descriptions."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from lexiframe.operators.asof import as_of
from lexiframe.sources import corpus, layout, sinks, versions
from lexiframe.streaming.incremental import run_marked


def _path(name):
    return os.path.join(tempfile.mkdtemp(prefix="lexiframe-test-", dir="/tmp"), name)


def test_positions_read_only_their_blocks(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("k"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    path = layout.write_positions(df.repartition(5), _path("rows"), "k", rows_per_block=100)
    want = spark.createDataFrame([(7,), (7,), (250,), (999,), (5000,), (None,)], "row long")
    got = layout.fetch_positions(spark, path, want, rows_per_block=100)
    assert sorted((r.row, r.k, r.text) for r in got.collect()) == [(7, 21, "t7"), (250, 750, "t250"), (999, 2997, "t999")]
    assert {f.split("block=")[1].split("/")[0] for f in got.inputFiles()} == {str(i) for i in range(10)}  # what there is
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [block" in scan or "block#" in scan.split("PartitionFilters")[1][:80]
    files = spark.read.parquet(path).where(F.col("block").isin(0, 2, 9, 50))
    assert {r[0] for r in files.select("block").distinct().collect()} == {0, 2, 9}
    assert layout.fetch_positions(spark, path, want.limit(0), rows_per_block=100).count() == 0


def test_fail_ignore_overwrite(spark):
    path = _path("data")
    one = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    versions.save_version(one, path)
    with pytest.raises(FileExistsError):
        versions.save_version(one, path)
    versions.save_version(one.where("id = 2"), path, "ignore")
    assert versions.read_version(spark, path).count() == 2 and versions.versions(spark, path) == [1]
    versions.save_version(one.where("id = 2"), path, "overwrite")
    assert [tuple(r) for r in versions.read_version(spark, path).collect()] == [(2, "test")]
    assert versions.read_version(spark, path, "train").count() == 0
    assert versions.read_version(spark, path, version=1).count() == 2
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path, version=9)
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, _path("none"))
    with pytest.raises(ValueError):
        versions.save_version(one, path, "append")


def test_a_failed_overwrite_leaves_the_old_data(spark):
    path = _path("data")
    good = spark.createDataFrame([(i, "train") for i in range(50)], "id int, split string")
    versions.save_version(good, path)
    bad = good.repartition(4, "id").withColumn("id", F.when(F.col("id") == 37, F.raise_error(F.lit("broken"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        versions.save_version(bad, path, "overwrite")
    assert versions.versions(spark, path) == [1]
    assert sorted(r.id for r in versions.read_version(spark, path).collect()) == list(range(50))
    versions.save_version(good.where("id < 3"), path, "overwrite")
    assert versions.drop_old_versions(spark, path) == 2  # the first version, and what the failed write left
    assert versions.versions(spark, path) == [2] and versions.read_version(spark, path).count() == 3


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_as_of_equals_a_search(spark, width):
    rng = random.Random(width)
    left = [(rng.randint(0, 300), f"l{i}") for i in range(200)] + [(None, "null")]
    right = [(rng.randint(20, 300), rng.random()) for _ in range(40)] + [(50, None), (None, 1.0)]
    got = as_of(spark.createDataFrame(left, "step long, name string"), spark.createDataFrame(right, "step long, v double"),
                "step", "v", width)
    want = {}
    for s, n in left:
        known = [(t, v) for t, v in right if t is not None and v is not None and s is not None and t <= s]
        want[n] = max(known)[1] if known else None
    assert {r.name: r.v for r in got.collect()} == want and got.columns == ["step", "name", "v"]


def test_killed_between_data_and_marker(spark):
    """The rerun writes the same micro-batch again; a third run finds nothing to do."""
    source, sink, ck, progress = (_path(n) for n in ("in", "out", "ck", "progress"))
    for part in range(3):
        spark.createDataFrame([(part * 10 + i, f"text {i}") for i in range(10)], "doc_id long, text string") \
            .coalesce(1).write.mode("append").parquet(source)

    def killed(batch):
        if batch == 1:
            raise RuntimeError("killed")
        sinks.save_progress(spark, progress, "stream", batch + 1)

    def go(mark=None):
        run_marked(spark, source, "doc_id long, text string", sink, ck, progress, max_files_per_trigger=1, mark=mark)

    with pytest.raises(Exception, match="killed"):
        go(killed)
    assert sinks.load_progress(spark, progress, "stream") == 1
    go()
    go()
    rows = [r.doc_id for r in spark.read.parquet(sink).collect()]
    assert sorted(rows) == list(range(30))
    assert sinks.load_progress(spark, progress, "stream") == 3


def test_a_marked_batch_is_skipped(spark):
    """The marker is there but the stream's own position is lost: nothing is written twice."""
    source, sink, progress = (_path(n) for n in ("in", "out", "progress"))
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(source)
    for _ in range(2):
        run_marked(spark, source, "doc_id long, text string", sink, _path("ck"), progress)
    assert spark.read.parquet(sink).count() == 1 and sinks.load_progress(spark, progress, "stream") == 1


def test_scratch_tables_go(spark):
    from lexiframe import session

    kept = spark.range(5)
    a, b = session.materialize(kept, "one"), session.materialize(kept, "two")
    session.release(a)
    session.release(kept)  # was never written
    assert not os.path.exists(a._scratch_path.replace("file:", "")) and b.count() == 5
    assert session.clear_scratch(spark) >= 1 and session.clear_scratch(spark) == 0
    assert not os.path.exists(b._scratch_path.replace("file:", ""))


def test_arguments_come_back(spark):
    args = {"lr": 1e-4, "name": "a: b\nc", "langs": ["en", "de"], "none": None, "n": 3}
    path = sinks.save_args(spark, args, _path("args"))
    assert sinks.load_args(spark, path) == args
    assert [r[0] for r in spark.read.text(path).collect()][0] == 'langs: ["en", "de"]'
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.save_args(spark, args, path)


def test_columns_of_an_empty_table_and_odd_names(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "`a b` int, `n.m` string")
    assert [tuple(r) for r in corpus.dataset_columns(df).collect()] == [(0, "a b", "int", 2, 0), (1, "n.m", "string", 2, 1)]
    assert [r.n_rows for r in corpus.dataset_columns(df.limit(0)).collect()] == [0, 0]
