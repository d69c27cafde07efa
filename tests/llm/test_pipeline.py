import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiframe.llm import langid, packing, toxicity
from lexiframe.llm.common import fold as fold_col
from tests.llm.test_simhash import _classes, _fingerprint
from tests.llm.util import TEXTS

SF001 = "/root/testdata/sf0.001"


def _plain(spark, df, sf_dir):
    """The same stages on the driver: the fitted models score the rows one by one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    tox = toxicity.fit_toxicity(df, labels, fold_col(F.col("doc_id"), 5) != 0)
    rows = [r for r in df.collect() if tox.score([r.text or ""])[0] < 0.5]
    left = spark.createDataFrame(rows, df.schema)
    langs, counts = langid.count_matrix(left, fold_col(F.col("doc_id"), 4) != 2)
    logp = langid.log_matrix(counts)

    def sure(t):
        if not t or not any(map(str.isalpha, t)):
            return False
        s = langid.score_texts([t], logp, langid.BITS)[0]
        return 1 / np.exp(s - s.max()).sum() >= corpus_pipeline.MIN_LANGUAGE_SCORE

    rows = [r for r in rows if sure(r.text)]
    roots = _classes([_fingerprint(r.text) for r in rows])
    first = {}
    for r, x in zip(rows, roots):
        if x not in first or (r.doc_id is not None and first[x].doc_id is not None and r.doc_id < first[x].doc_id) \
                or r.doc_id is None:
            first[x] = r
    enc = packing.UnitEncoder(*packing.default_paths())
    return sorted((str(r.doc_id), len(enc.encode(r.text)) // 4 + 1) for r in first.values())


def test_run_equals_plain_stages(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    out = corpus_pipeline.run(spark, SF001)
    got = sorted({(str(r.doc_id), r.doc_tokens) for r in out.collect()})
    assert got == _plain(spark, df, SF001)
    total = out.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"))
    assert total.where("n <> doc_tokens").count() == 0


def test_stages_with_awkward_rows(spark, tmp_path):
    base = spark.read.parquet(f"{SF001}/documents.parquet").limit(60)
    odd = [(900 + i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(None, "odd text with no id", "en", "s", 1)]
    df = base.unionByName(spark.createDataFrame(odd + odd[:2], base.schema)).withColumn("score", F.lit("clash")) \
        .withColumn("_row", F.lit(1)).withColumn("predicted", F.lit(2)).coalesce(1)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, df, SF001).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.schema.names == df.schema.names
        key = lambda r: repr(r)
        before = {key(r) for r in df.collect()}
        rows = after.collect()
        assert rows and {key(r) for r in rows} <= before
        df = after
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, df, SF001).select("doc_id").distinct().count() == df.select("doc_id").distinct().count()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty_table(spark, stage):
    assert stage(spark, spark.read.parquet(f"{SF001}/documents.parquet").limit(0), SF001).count() == 0
