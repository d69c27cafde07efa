import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from lexiframe.sources import corpus as C
from lexiframe.sources import sinks as S
from lexiframe.streaming.incremental import prepare_text, run_incremental

SCHEMA = "doc_id long, text string"


def test_stream_equals_batch_and_resumes(spark):
    base = tempfile.mkdtemp(dir="/tmp")
    src, out, ck = (os.path.join(base, x) for x in ("src", "out", "ck"))
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    docs.where("doc_id % 2 = 0").write.parquet(os.path.join(src, "part1"))
    run_incremental(spark, os.path.join(src, "*"), SCHEMA, out, ck)
    first = spark.read.parquet(out).count()
    docs.where("doc_id % 2 = 1").write.parquet(os.path.join(src, "part2"))
    run_incremental(spark, os.path.join(src, "*"), SCHEMA, out, ck)
    got = spark.read.parquet(out)
    want = prepare_text(docs)
    assert first == prepare_text(docs.where("doc_id % 2 = 0")).count()
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_export_skip_if_exists(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    path = os.path.join(d, "lines")
    texts = spark.createDataFrame([(0, "a\nb"), (1, "  "), (2, "c")], "doc_id long, text string")
    assert S.export_text_rows(texts, path, order=["doc_id"]) == path
    assert S.export_text_rows(texts.limit(1), path) == path  # target exists: kept as is
    assert sorted(r[0] for r in C.read_lines(spark, path).collect()) == ["a", "b", "c"]


def test_bilingual_order(spark):
    rows = spark.createDataFrame([(0, 0, ("hallo", "hello"))], "conv_id long, turn long, translation struct<de:string,en:string>")
    r = C.project_pair(rows, "de-en", source_lang="en", target_lang="de").first()
    assert r["source"] == "hello" and r["target"] == "hallo"
    # only the source overridden: the target stays the pair's second language
    r = C.project_pair(rows, "de-en", source_lang="en").first()
    assert r["source"] == "hello" and r["target"] == "hello"
    assert C.project_pair(rows, "de-en").first()["source"] == "hallo"
    lines = [r["value"] for r in S.bilingual_lines(rows, "de-en").orderBy("side").collect()]
    assert lines == ["hallo", "hello"]


def test_progress_marker(spark):
    path = os.path.join(tempfile.mkdtemp(dir="/tmp"), "progress")
    assert S.load_progress(spark, path, "run") == 0
    S.save_progress(spark, path, "run", 1)
    S.save_progress(spark, path, "run", 3)
    assert S.load_progress(spark, path, "run") == 3


def test_prepared_split_pruned(spark):
    path = os.path.join(tempfile.mkdtemp(dir="/tmp"), "prepared")
    docs = C.assign_split(spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text"), "doc_id")
    S.save_prepared(docs, path)
    tr = C.read_prepared(spark, path, "train")
    plan = tr._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "(split#" in plan
    assert tr.count() == docs.where(F.col("split") == "train").count()


def test_paragraph_rows(spark):
    df = spark.createDataFrame([(0, "a\n\nb\n")], "doc_id long, text string")
    got = [(r["para"], r["text"]) for r in C.paragraph_rows(df).orderBy("para").collect()]
    assert got == [(0, "a"), (1, ""), (2, "b"), (3, "")]
