import json
import os
import tempfile

from pyspark.sql import functions as F

from lexiframe.operators import batches as B
from lexiframe.operators.bpe import BpeModel, add_pad_token, encode
from lexiframe.operators.vocab import ids_to_tokens, ids_to_tokens_col, token_ids, vocab_size
from lexiframe.sources import corpus as C
from lexiframe.sources import sinks as S


def _vocab(spark):
    return spark.createDataFrame([("[UNK]", 0, "special"), ("[PAD]", 1, "special"), ("[EOS]", 2, "special"),
                                  ("a", 3, "alphabet"), ("b", 4, "alphabet")], "token string, id int, kind string")


def test_token_ids_unknown(spark):
    toks = spark.createDataFrame([("a",), ("z",), ("b",)], "token string")
    got = {r["token"]: r["id"] for r in token_ids(toks, _vocab(spark)).collect()}
    assert got == {"a": 3, "z": 0, "b": 4}
    assert vocab_size(_vocab(spark)).first()[0] == 5


def test_ids_to_tokens_both_forms_drop_every_eos(spark):
    seqs = spark.createDataFrame([(0, [3, 2, 4, 2]), (1, [])], "k long, ids array<int>")
    joined = {r["k"]: r["tokens"] for r in ids_to_tokens(seqs, _vocab(spark), "k", remove_id=2).collect()}
    assert joined == {0: ["a", "b"], 1: []}
    lit = seqs.select("k", ids_to_tokens_col(F.col("ids"), ["[UNK]", "[PAD]", "[EOS]", "a", "b"], 2).alias("t"))
    assert {r["k"]: r["t"] for r in lit.collect()} == {0: ["a", "b"], 1: []}
    keep = seqs.select(ids_to_tokens_col(F.col("ids"), ["[UNK]", "[PAD]", "[EOS]", "a", "b"]).alias("t")).first()
    assert keep["t"] == ["a", "[EOS]", "b", "[EOS]"]


def test_supplied_vocab_with_pad(spark):
    m = BpeModel(["[UNK]", "a", "b", "ab"], ["special", "alphabet", "alphabet", "merge"], [(1, 2, 3)], ["[UNK]"])
    m2 = add_pad_token(m)
    assert m2.token_to_id("[PAD]") == 4 and add_pad_token(m2) is m2
    df = spark.createDataFrame([("ab ba abab",)], "t string")
    assert df.select(encode(F.col("t"), m2)).first()[0] == [3, 2, 1, 3, 3]


def test_clip_grow_and_length(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],)], "ids array<int>")
    r = df.select(B.clip(F.col("ids"), 2).alias("c"), B.grow(F.col("ids"), 0, 3).alias("g")).first()
    assert r["c"] == [1, 2] and r["g"] == [1, 2, 3, 4, 0, 0, 0]
    assert C.dataset_length(df).first()["n_rows"] == 1


def test_write_records(spark):
    path = os.path.join(tempfile.mkdtemp(dir="/tmp"), "history")
    hist = spark.createDataFrame([(0, 0, 1.5, 2.5), (0, 256, 1.2, 2.4)], "epoch int, step long, loss double, val_loss double")
    S.write_records(hist, path)
    rows = []
    for f in sorted(os.listdir(path)):
        if f.endswith(".json"):
            rows += [json.loads(line) for line in open(os.path.join(path, f))]
    assert sorted(r["step"] for r in rows) == [0, 256]


def test_tokenizer_tables_round_trip(spark):
    from lexiframe.operators.bpe import train_bpe

    docs = spark.createDataFrame([(0, "lower lowest newer newest"), (1, "low low new")], "doc_id long, text string")
    m = train_bpe(docs, 25)
    path = os.path.join(tempfile.mkdtemp(dir="/tmp"), "tok")
    S.save_tokenizer(m.vocab_frame(spark), m.merges_frame(spark), path)
    vocab, merges = S.load_tokenizer(spark, path)
    back = BpeModel.from_frames(vocab, merges)
    assert back.tokens == m.tokens and back.merges == m.merges
    t = spark.createDataFrame([("lowest newer",)], "t string")
    assert t.select(encode(F.col("t"), back)).first()[0] == t.select(encode(F.col("t"), m)).first()[0]
