import hashlib

from pyspark.sql import functions as F

from lexiframe.operators import batches as B
from lexiframe.operators.bpe import with_markers


def test_global_index_matches_hash_order(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "k")
    got = {r["k"]: r["idx"] for r in B.global_index(df, "k", seed=7).collect()}
    order = sorted(range(500), key=lambda k: (hashlib.md5(f"7:{k}".encode()).hexdigest(), k))
    assert got == {k: i for i, k in enumerate(order)}


def test_last_partial_batch(spark):
    df = spark.range(0, 130).withColumnRenamed("id", "k")
    b = B.assign_batches(df, "k", 64, 0)
    sizes = sorted((r["batch_id"], r["count"]) for r in b.groupBy("batch_id").count().collect())
    assert sizes == [(0, 64), (1, 64), (2, 2)]
    slots = b.where("batch_id = 2").select("slot").collect()
    assert sorted(r[0] for r in slots) == [0, 1]


def test_long_row_truncation(spark):
    df = spark.createDataFrame([(list(range(10, 310)),)], "ids array<int>")
    out = df.select(with_markers(F.col("ids"), 6, 5, 256).alias("x")).first()["x"]
    assert len(out) == 256 and out[0] == 6 and out[-1] != 5


def test_target_marker(spark):
    df = spark.createDataFrame([([40],)], "ids array<int>")
    assert df.select(with_markers(F.col("ids"), 3, 5, 256)).first()[0] == [3, 40, 5]
    assert df.select(with_markers(F.col("ids"), None, None, 256)).first()[0] == [40]


def test_padding_and_masks(spark):
    df = spark.createDataFrame([(0, 0, [7]), (0, 1, [7, 8, 9])], "batch_id long, slot int, ids array<int>")
    out = sorted(B.pad_batches(df, ["ids"], 1).collect(), key=lambda r: r["slot"])
    assert [r["ids"] for r in out] == [[7, 1, 1], [7, 8, 9]]
    assert [r["ids_attention_mask"] for r in out] == [[1, 0, 0], [1, 1, 1]]


def test_padding_is_per_batch(spark):
    df = spark.createDataFrame([(0, 0, [7]), (0, 1, [7, 8, 9]), (1, 0, [4, 4])],
                               "batch_id long, slot int, ids array<int>")
    out = {(r["batch_id"], r["slot"]): r["ids"] for r in B.pad_batches(df, ["ids"], 1).collect()}
    assert out == {(0, 0): [7, 1, 1], (0, 1): [7, 8, 9], (1, 0): [4, 4]}


def test_shift_short_row(spark):
    # [BOS] a [EOS] [PAD] with mask 1 1 1 0
    df = spark.createDataFrame([([6, 40, 5, 1], [1, 1, 1, 0])], "ids array<int>, m array<int>")
    s = B.shift(F.col("ids"), F.col("m"))
    r = df.select(*[c.alias(k) for k, c in s.items()]).first()
    assert r["input_ids"] == [6, 40, 5]
    assert r["labels"] == [40, 5, 1]
    assert r["labels_mask"] == [1, 1, 0]


def test_flatten_tokens(spark):
    df = spark.createDataFrame([(3, [40, 5, 1], [1, 1, 0])], "seq_id long, labels array<int>, labels_mask array<int>")
    rows = [tuple(r) for r in B.flatten_tokens(df, ["seq_id"]).orderBy("pos").collect()]
    assert rows == [(3, 0, 40, 1), (3, 1, 5, 1), (3, 2, 1, 0)]


def test_unpad_with_gap(spark):
    df = spark.createDataFrame([([5, 6, 7], [1, 0, 1])], "ids array<int>, m array<int>")
    r = df.select(B.unpad(F.col("ids"), F.col("m")).alias("k"),
                  B.last_real_position(F.col("m")).alias("p")).first()
    assert r["k"] == [5, 7] and r["p"] == 1


def test_unpad_of_pad_is_identity(spark):
    rows = [(0, i, list(range(1, 1 + n))) for i, n in enumerate([1, 4, 2, 7])]
    df = spark.createDataFrame(rows, "batch_id long, slot int, ids array<int>")
    p = B.pad_batches(df.withColumn("orig", F.col("ids")), ["ids"], 0)
    assert all(r["k"] == r["orig"] for r in p.select(B.unpad(F.col("ids"), F.col("ids_attention_mask")).alias("k"),
                                                        "orig").collect())


def test_resume_and_cadence(spark):
    df = spark.createDataFrame([(i,) for i in range(3)], "batch_id long")
    assert [r[0] for r in B.resume_from(df, 2).collect()] == [2]
    assert sorted(r[0] for r in B.resume_from(df, 0).collect()) == [0, 1, 2]
    many = spark.createDataFrame([(i,) for i in range(10)], "batch_id long")
    got = sorted((r["batch_id"], r["step"]) for r in B.cadence(many, 256, 64).collect())
    assert got == [(0, 0), (4, 256), (8, 512)]


def test_collate_orders_slots(spark):
    df = spark.createDataFrame([(0, 1, "b"), (0, 0, "a"), (1, 0, "c")], "batch_id long, slot int, v string")
    got = {r["batch_id"]: r["v"] for r in B.collate(df, ["v"]).collect()}
    assert got == {0: ["a", "b"], 1: ["c"]}


def test_resume_plus_prefix_is_whole(spark):
    df = spark.range(0, 300).withColumnRenamed("id", "k")
    b = B.assign_batches(df, "k", 64, 5)
    for k in (0, 2, 4, 9):
        head = b.where(F.col("batch_id") < k)
        tail = B.resume_from(b, k)
        assert head.count() + tail.count() == 300
        assert head.unionByName(tail).exceptAll(b).count() == 0


def test_mask_sums_equal_lengths_on_lm_batches(spark):
    from conftest import SF001
    from lexiframe.plans import prep

    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    m = prep.char_model(docs)
    seqs = prep.lm_sequences(docs, m, max_length=40)
    b = prep.lm_batches(seqs, m, batch_size=16, seed=1)
    r = b.join(seqs.withColumnRenamed("ids", "raw"), "doc_id").agg(
        F.sum(B.real_length(F.col("ids_attention_mask"))).alias("masked"),
        F.sum(F.size("raw")).alias("lengths"),
        F.sum(F.when(B.unpad(F.col("ids"), F.col("ids_attention_mask")) == F.col("raw"), 1).otherwise(0)).alias("same"),
        F.count(F.lit(1)).alias("n")).first()
    assert r["masked"] == r["lengths"] and r["same"] == r["n"]
