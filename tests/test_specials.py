"""Special tokens in text: no limit on their number, and no text can pass for one."""

from pyspark.sql import functions as F

from lexiframe.operators.bpe import BpeModel, encode
from lexiframe.operators.vocab import ids_to_tokens_col
from lexiframe.sources import sinks as S


def _model(n_specials):
    specials = [f"<s{i}>" for i in range(n_specials)]
    tokens = specials + list("abc﷐﷑﷕")
    return BpeModel(tokens, ["special"] * n_specials + ["alphabet"] * 6, [], specials, specials[0])


def test_many_specials_and_noncharacters(spark):
    m = _model(1000)
    at = {t: i for i, t in enumerate(m.tokens)}
    texts = ["a<s999>b", "ab ﷕ c", "﷐﷕﷐", "a﷐﷑<s31><s32>﷐", "<s1>", "<S1>"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(encode(F.col("text"), m)).collect()]
    ids = lambda *ts: [at.get(t, 0) for t in ts]
    assert got == [ids("a", "<s999>", "b"), ids("a", "b", "﷕", "c"), ids("﷐", "﷕", "﷐"),
                   ids("a", "﷐", "﷑", "<s31>", "<s32>", "﷐"), ids("<s1>"), ids("?", "?", "?", "?")]


def test_pair_keys_of_long_conversations_stay_apart(spark):
    from lexiframe.operators.bleu import sentence_stats
    from lexiframe.plans.prep import conversation_bleu_pairs

    df = spark.createDataFrame([(0, 1_000_000, "a b", "a b"), (1, 0, "c d", "x y")],
                               "conv_id long, turn int, source string, target string")
    got = {(r.conv_id, r.turn): r.num for r in sentence_stats(conversation_bleu_pairs(df), ("conv_id", "turn")).collect()
           if r.n == 1}
    assert got == {(0, 1_000_000): 2, (1, 0): 0}


def test_tokens_without_a_vector_keep_their_row(spark):
    from lexiframe.operators.vectors import lookup_vectors

    t = spark.createDataFrame([(1,), (2,), (2,)], "token_id long")
    v = spark.createDataFrame([(1, [0.5])], "id long, vector array<double>")
    rows = lookup_vectors(t, v).collect()
    assert len(rows) == 3 and sum(r.vector is None for r in rows) == 2


def test_large_vocabulary_lookup(spark):
    tokens = [f"t{i}" for i in range(250_000)]
    df = spark.createDataFrame([([0, 249_999, 7],)], "ids array<int>")
    assert df.select(ids_to_tokens_col(F.col("ids"), tokens)).first()[0] == ["t0", "t249999", "t7"]


def test_progress_takes_the_last_marker_and_raises_on_damage(spark, tmp_path):
    path = str(tmp_path / "progress")
    assert S.load_progress(spark, path, "r") == 0
    S.save_progress(spark, path, "r", 9)
    S.save_progress(spark, path, "r", 4)  # a run may go back
    assert S.load_progress(spark, path, "r") == 4 and S.load_progress(spark, path, "other") == 0


def test_pairs_of_two_tables(spark):
    from lexiframe.operators.bleu import corpus_bleu, pair_up

    hyps = spark.createDataFrame([(0, 0, list("abcd")), (0, 1, list("xyzw"))], "batch_id long, slot int, hyp array<string>")
    refs = spark.createDataFrame([(0, 0, list("abcd")), (0, 0, list("abce"))], "batch_id long, slot int, ref array<string>")
    rows = {r.slot: r.refs for r in pair_up(hyps, refs).collect()}
    assert sorted(rows[0]) == [list("abcd"), list("abce")] and rows[1] == []
    assert corpus_bleu(pair_up(hyps, refs), ("batch_id", "slot")).first()["p1"] == 0.5
