import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from lexiframe.functions.text import SPECIAL_TOKENS
from lexiframe.operators.bpe import BpeModel, encode, merge_symbols, train_bpe
from lexiframe.plans.prep import char_model


def plain_merges(words, n_tokens, alphabet):
    """One merge at a time over whole words: the top pair by (count, smaller left id, smaller right id)."""
    tokens = SPECIAL_TOKENS + alphabet
    ids = {t: i for i, t in enumerate(tokens)}
    seqs = [([ids[c] for c in w], n) for w, n in words]
    merges = []
    while len(tokens) < n_tokens:
        counts = {}
        for s, n in seqs:
            for p in zip(s, s[1:]):
                counts[p] = counts.get(p, 0) + n
        if not counts:
            break
        l, r = min(counts, key=lambda p: (-counts[p], p))
        text = tokens[l] + tokens[r]
        new = ids.setdefault(text, len(tokens))
        if new == len(tokens):
            tokens.append(text)
        merges.append((l, r, new))
        for k, (s, n) in enumerate(seqs):
            out, i = [], 0
            while i < len(s):
                if s[i:i + 2] == [l, r]:
                    out.append(new)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            seqs[k] = (out, n)
    return tokens, merges


ROUNDS = [dict(first_pairs=1), dict(first_pairs=3, max_pairs=5), dict(first_pairs=64, max_islands=4), {}]


@pytest.mark.parametrize("bounds", ROUNDS)
def test_rounds_equal_one_merge_at_a_time(spark, bounds):
    """Whatever a round may hold; words with runs, and merges whose text is a token already."""
    rng = random.Random(4)
    words = [("aaaa", 5), ("aaaaaaa", 3), ("abab", 7), ("abc", 9), ("bcd", 4), ("cdcd", 6), ("dd", 8), ("x", 50)]
    words += [("".join(rng.choice("abcd") for _ in range(rng.randint(2, 12))), rng.randint(1, 6)) for _ in range(60)]
    words = sorted(dict(words).items())
    wt = spark.createDataFrame(words, "word string, n long")
    docs = spark.createDataFrame([(0, "x")], "doc_id long, text string")
    m = train_bpe(docs, 60, word_table=wt, **bounds)
    assert (m.tokens, m.merges) == plain_merges(words, 60, list("abcdx"))


def test_a_merge_whose_text_is_a_token(spark):
    """``ab`` is a special here, so merging a and b gives an old id."""
    words = [("abab", 9), ("abc", 7), ("cab", 5), ("bc", 3)]
    wt = spark.createDataFrame(words, "word string, n long")
    m = train_bpe(wt, 12, word_table=wt, specials=["[UNK]", "ab"], first_pairs=2)
    assert m.merges[0] == (2, 3, 1) and m.tokens[:5] == ["[UNK]", "ab", "a", "b", "c"]


def test_islands_are_whole_when_counts_pass_doubles(spark):
    big = 2 ** 55
    words = [("ab", big + 1), ("cd", big), ("abcd", 1), ("xy", 2)]
    wt = spark.createDataFrame(words, "word string, n long")
    m = train_bpe(wt, 30, word_table=wt)
    assert (m.tokens, m.merges) == plain_merges(words, 30, list("abcdxy"))


def test_long_words_are_merged_in_order_of_rank():
    """The heap against a plain loop, and a word of a million characters."""
    rng = random.Random(9)
    merges = [(1, 2, 3), (3, 1, 4), (2, 2, 5), (4, 5, 6), (6, 6, 7), (1, 1, 8)]
    ranks = {a << 32 | b: r << 32 | c for r, (a, b, c) in enumerate(merges)}

    def plain(s):
        while True:
            here = [(ranks[a << 32 | b], i) for i, (a, b) in enumerate(zip(s, s[1:])) if a << 32 | b in ranks]
            if not here:
                return s
            e, i = min(here)
            s = s[:i] + [e & (1 << 32) - 1] + s[i + 2:]

    for _ in range(300):
        s = [rng.choice((1, 2)) for _ in range(rng.randint(0, 14))]
        assert merge_symbols(s, ranks) == plain(s)
    assert len(merge_symbols([1, 2] * 500_000, ranks)) == 500_000


def _library(texts, size):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import models, normalizers, pre_tokenizers, trainers

    tok = tokenizers.Tokenizer(models.BPE(unk_token="[UNK]"))
    tok.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.Lowercase(), normalizers.StripAccents()])
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=size, special_tokens=SPECIAL_TOKENS, show_progress=False))
    return tok


@pytest.mark.slow
def test_thirty_thousand_entries_equal_the_library(spark):
    """Vocabulary, merges and all encodings of the registered queries at full size."""
    from conftest import SF01
    from lexiframe.plans import catalog

    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    tok = _library([r.text for r in rows], catalog.BPE_VOCAB_SIZE)
    theirs = sorted(tok.get_vocab(), key=tok.get_vocab().get)
    vocab = {r.id: r.token for r in catalog.q_bpe_vocab(spark, SF01).collect()}
    assert [vocab[i] for i in range(len(vocab))] == theirs and len(theirs) == 30_000
    got = {r.doc_id: r.ids_str for r in catalog.q_bpe_encode(spark, SF01).collect()}
    assert got == {r.doc_id: " ".join(map(str, tok.encode(r.text).ids)) for r in rows}


@pytest.mark.slow
def test_training_on_files_and_web_flow_equal_the_library(spark):
    from tokenizers import Tokenizer

    import public_tokenizers
    from lexiframe.plans import catalog
    from lexiframe.sources import corpus

    docs = corpus.assign_split(corpus.text_rows(spark, SF001), "doc_id", catalog.SEED, catalog.SPLIT_FRACTIONS).collect()
    tok = _library([r.text for r in docs if r.split != "test"], catalog.BPE_SMALL_SIZE)
    conv = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF001}/conversations.parquet").collect()}
    got = {(r.conv_id, r.turn): r.ids_str for r in catalog.q_bpe_of_files(spark, SF001).collect()}
    assert got == {k: " ".join(map(str, tok.encode(t).ids)) for k, t in conv.items()}

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pad, mark = lib.get_vocab_size(), lib.token_to_id("<|endoftext|>")
    want = {r.doc_id: ([mark] + lib.encode(r.text, add_special_tokens=False).ids + [mark])[:catalog.MAX_LENGTH]
            for r in docs if r.split == "train"}
    rows = catalog.q_web_supplied_batches(spark, SF001).collect()
    assert {r.doc_id for r in rows} == set(want)
    longest = {}
    for r in rows:
        longest[r.batch_id] = max(longest.get(r.batch_id, 0), len(want[r.doc_id]))
    for r in rows:
        ids = want[r.doc_id]
        more = longest[r.batch_id] - len(ids)
        assert r.ids_str == " ".join(map(str, ids + [pad] * more))
        assert r.mask_str == " ".join(["1"] * len(ids) + ["0"] * more)


def test_specials_and_unknown(spark):
    docs = spark.createDataFrame([(0, "ab ba")], "doc_id long, text string")
    m = char_model(docs)
    df = spark.createDataFrame([("[BOS]ab[EOS] z",)], "t string")
    ids = df.select(encode(F.col("t"), m)).first()[0]
    a, b = m.tokens.index("a"), m.tokens.index("b")
    assert ids == [SPECIAL_TOKENS.index("[BOS]"), a, b, SPECIAL_TOKENS.index("[EOS]"), 0]
    # lower-case look-alikes are ordinary text
    ids2 = df.select(encode(F.lit("[bos]"), m)).first()[0]
    assert SPECIAL_TOKENS.index("[BOS]") not in ids2


def test_model_round_trip_tables(spark):
    docs = spark.createDataFrame([(0, "hello hello world")], "doc_id long, text string")
    m = train_bpe(docs, 20)
    back = BpeModel.from_frames(m.vocab_frame(spark), m.merges_frame(spark))
    assert back.tokens == m.tokens and back.merges == m.merges


@pytest.mark.slow
def test_against_tokenizers_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers.models import BPE
    from tokenizers.normalizers import NFD, Lowercase, Sequence, StripAccents
    from tokenizers.pre_tokenizers import Whitespace
    from tokenizers.trainers import BpeTrainer

    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    V = 120
    model = train_bpe(docs, V)
    d = tempfile.mkdtemp(dir="/tmp")
    f = os.path.join(d, "corpus.txt")
    rows = docs.orderBy("doc_id").collect()
    with open(f, "w") as fp:
        for r in rows:
            if r.text.strip():
                fp.write(r.text + "\n")
    tok = tokenizers.Tokenizer(BPE(unk_token="[UNK]"))
    tok.normalizer = Sequence([NFD(), Lowercase(), StripAccents()])
    tok.pre_tokenizer = Whitespace()
    tok.train([f], BpeTrainer(vocab_size=V, special_tokens=SPECIAL_TOKENS, show_progress=False))
    theirs = [t for t, _ in sorted(tok.get_vocab().items(), key=lambda kv: kv[1])]
    assert model.tokens == theirs
    enc = {r.doc_id: list(r.ids) for r in docs.select("doc_id", encode(F.col("text"), model).alias("ids")).collect()}
    for r in rows[:40]:
        assert enc[r.doc_id] == tok.encode(r.text).ids


def test_truncated_encoding_equals_whole_then_cut(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    m = char_model(docs)
    both = docs.select(F.slice(encode(F.col("text"), m), 1, 50).alias("a"),
                       encode(F.col("text"), m, max_ids=50).alias("b"),
                       F.size(encode(F.col("text"), m)).alias("n"))
    rows = both.collect()
    assert any(r["n"] > 50 for r in rows)
    assert all(r["a"] == r["b"] for r in rows)


@pytest.mark.slow
def test_lm_sequences_equal_library_with_markers_and_truncation(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers.models import BPE
    from tokenizers.normalizers import NFD, Lowercase, Sequence, StripAccents
    from tokenizers.pre_tokenizers import Whitespace
    from tokenizers.trainers import BpeTrainer

    from lexiframe.plans.prep import lm_sequences

    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    V, L = 110, 64
    model = train_bpe(docs, V)
    rows = docs.orderBy("doc_id").collect()
    d = tempfile.mkdtemp(dir="/tmp")
    f = os.path.join(d, "corpus.txt")
    with open(f, "w") as fp:
        for r in rows:
            if r.text.strip():
                fp.write(r.text + "\n")
    tok = tokenizers.Tokenizer(BPE(unk_token="[UNK]"))
    tok.normalizer = Sequence([NFD(), Lowercase(), StripAccents()])
    tok.pre_tokenizer = Whitespace()
    tok.train([f], BpeTrainer(vocab_size=V, special_tokens=SPECIAL_TOKENS, show_progress=False))
    tok.enable_truncation(max_length=L)
    got = {r.doc_id: list(r.ids) for r in lm_sequences(docs, model, max_length=L).collect()}
    for r in rows:
        if r.text != "":
            assert got[r.doc_id] == tok.encode("[BOS]" + r.text + "[EOS]").ids, r.doc_id


def test_byte_level_matches_library(spark):
    """A supplied byte-level vocabulary gives the library's ids: case, spaces, any bytes, specials in the text."""
    import os

    import pytest
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from lexiframe.operators.bpe import encode_byte_level, load_byte_model

    path = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.json")
    if not os.path.exists(path):
        pytest.skip("no supplied vocabulary")
    texts = ["", " ", "Hello  World's  end \n\n x", "\u00c9t\u00e9 \u4f60\u597d \U0001F600!? 12\u00bd", "a\u0000b\u007f\u00a0\u00ad\t",
             "<|endoftext|>it's<|endoftext|> <|endoftext", "we'll WE'LL   ", "\u039f\u0394\u039f\u03a3 \u0130\u0131"]
    lib = Tokenizer.from_file(path)
    model = load_byte_model(spark, path)
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "i int, text string")
    got = {r.i: r for r in rows.select("i", encode_byte_level(F.col("text"), model).alias("ids"),
                                       encode_byte_level(F.col("text"), model, 3).alias("cut")).collect()}
    for i, t in enumerate(texts):
        want = lib.encode(t, add_special_tokens=False).ids
        assert got[i].ids == want, t
        assert got[i].cut == want[:3]
    assert got[len(texts)].ids is None
