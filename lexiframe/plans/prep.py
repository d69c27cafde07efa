"""Composed flows: language-model and translation batches, scored tokens, BLEU pairs.

These chain the operators the way the three training scripts do; every step
is a DataFrame transformation, the only actions are the bounded ones (batch
count for the broadcast check, the index materialisation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.functions.text import non_empty, strip_heading, words
from lexiframe.operators.batches import assign_batches, pad_batches, shift
from lexiframe.operators.bpe import BpeModel, encode, encode_byte_level, with_markers
from lexiframe.operators.vocab import char_vocab


def char_model(texts: DataFrame, text: str = "text") -> BpeModel:
    """A vocabulary of specials + alphabet and no merges (a char-level encoder).
    Its size is bounded by the alphabet, so it is collected."""
    return BpeModel.from_frames(char_vocab(texts, text), texts.sparkSession.createDataFrame(
        [], "rank int, left string, right string, merged string"))


def lm_sequences(texts: DataFrame, model: BpeModel, key: str = "doc_id", text: str = "text",
                 max_length: int = 256, begin: str = "[BOS]", end: str = "[EOS]",
                 clean_headings: bool = True) -> DataFrame:
    """Language-model rows: drop empty texts, clean the first heading, encode
    ``begin + text + end`` and truncate on the right (narrow)."""
    rows = texts.where(non_empty(F.col(text)))
    if clean_headings:
        rows = rows.withColumn(text, strip_heading(F.col(text)))
    ids = with_markers(encode(F.col(text), model, max_ids=max_length - 1),
                       model.token_to_id(begin), model.token_to_id(end), max_length)
    return rows.select(key, ids.alias("ids"))


def lm_batches(seqs: DataFrame, model: BpeModel, key: str = "doc_id", batch_size: int = 64,
               seed: int = 0, pad: str = "[PAD]", by_batch: bool = False) -> DataFrame:
    """Shuffle by seed, batch, pad to the longest in each batch and add masks.

    The encoded rows (at most ``max_length`` ids each) are what the index
    shuffle moves; the text is not carried along.  ``by_batch``: as in ``pad_batches``.
    """
    return pad_batches(assign_batches(seqs, key, batch_size, seed), ["ids"], model.token_to_id(pad), by_batch=by_batch)


def lm_shifted(batches: DataFrame, ids: str = "ids", mask: str = "ids_attention_mask") -> DataFrame:
    s = shift(F.col(ids), F.col(mask))
    return batches.select("*", *[c.alias(n) for n, c in s.items()])


def mt_sequences(pairs: DataFrame, model: BpeModel, keys: tuple[str, ...] = ("conv_id", "turn"),
                 max_length: int = 256, begin: str = "[SEP]", end: str = "[EOS]") -> DataFrame:
    """Translation rows: source unmarked; target ``[SEP] target [EOS]``; both truncated."""
    src = with_markers(encode(F.col("source"), model, max_ids=max_length), None, None, max_length)
    tgt = with_markers(encode(F.col("target"), model, max_ids=max_length - 1),
                       model.token_to_id(begin), model.token_to_id(end), max_length)
    return pairs.select(*keys, src.alias("source_ids"), tgt.alias("target_ids"))


def mt_batches(seqs: DataFrame, model: BpeModel, keys: tuple[str, ...] = ("conv_id", "turn"),
               batch_size: int = 64, seed: int = 0, pad: str = "[PAD]") -> DataFrame:
    indexed = assign_batches(seqs, list(keys), batch_size, seed)
    return pad_batches(indexed, ["source_ids", "target_ids"], model.token_to_id(pad))


def scored_tokens(embeddings: DataFrame, batch_size: int = 64) -> DataFrame:
    """Stand-in scored tokens from the embeddings table: logits = the vector,
    class = ``label``, batch = ``vec_id div batch_size``, mask = ``vec_id % 5 <> 0``."""
    return embeddings.select(
        (F.col("vec_id") / batch_size).cast("long").alias("batch_id"),
        F.col("vec_id").alias("seq_id"),
        F.col("embedding").cast("array<double>").alias("z"),
        F.col("label"),
        F.when(F.col("vec_id") % 5 != 0, 1).otherwise(0).alias("mask"),
    )


def conversation_bleu_pairs(pairs: DataFrame) -> DataFrame:
    """Hypothesis = words of the user turn, one reference = words of the reply."""
    return pairs.select(
        "conv_id", "turn",
        words(F.col("source")).alias("hyp"),
        F.array(words(F.col("target"))).alias("refs"),
    )


def document_bleu_pairs(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against the next one in key order (near copies exist among
    neighbours).

    Only the keys go through the distributed index (range partitions, light);
    successor keys come from an equi-join on the rank and the texts are
    joined on by key.  No window over the whole table.
    """
    from lexiframe.operators.batches import global_index

    t = texts.select(key, text)
    idx = global_index(t.select(key), key, seed=None, out="_idx")
    succ = idx.join(idx.select((F.col("_idx") - 1).alias("_idx"), F.col(key).alias("_next")), "_idx") \
              .select(key, "_next")
    pairs = t.join(succ, key).join(t.select(F.col(key).alias("_next"), F.col(text).alias("_ref")), "_next")
    return pairs.select(F.col(key).alias("pair_id"), words(F.col(text)).alias("hyp"),
                        F.array(words(F.col("_ref"))).alias("refs"))


def unigram_batch_scorer(labels: str = "labels", mask: str = "labels_mask"):
    """A stand-in scorer for the batch hook: each label is scored by the
    batch's own unigram distribution over its counted labels
    (loss = -log(count / total)); positions with mask 0 get loss 0."""
    def score(pdf):
        import math

        import pandas as pd

        counts: dict = {}
        for lab, msk in zip(pdf[labels], pdf[mask]):
            for t, m in zip(lab, msk):
                if m == 1:
                    counts[t] = counts.get(t, 0) + 1
        total = sum(counts.values())
        out = []
        for b, d, lab, msk in zip(pdf["batch_id"], pdf["doc_id"], pdf[labels], pdf[mask]):
            for p, (t, m) in enumerate(zip(lab, msk)):
                loss = -math.log(counts[t] / total) if m == 1 else 0.0
                out.append((int(b), int(d), p, loss, int(m)))
        return pd.DataFrame(out, columns=["batch_id", "doc_id", "pos", "loss", "mask"])

    return score


def web_model(texts: DataFrame, marker: str = "<|endoftext|>", pad: str = "[PAD]",
              text: str = "text") -> BpeModel:
    """Web-text vocabulary stand-in: the marker as the only special, the
    alphabet after it, then a pad token added at ``max(id) + 1`` (the supplied
    vocabulary has none of its own)."""
    from lexiframe.operators.bpe import add_pad_token

    vocab = char_vocab(texts, text, specials=[marker])
    base = BpeModel.from_frames(vocab, texts.sparkSession.createDataFrame(
        [], "rank int, left string, right string, merged string"), specials=[marker], unk_token=marker)
    return add_pad_token(base, pad)


def web_sequences(texts: DataFrame, model: BpeModel, key: str = "doc_id", text: str = "text",
                  max_length: int = 256, marker: str = "<|endoftext|>", byte_level: bool = False) -> DataFrame:
    """Web-text rows: ``marker + text + marker``, encoded and truncated (no
    empty-row filter and no heading clean-up in this variant).  ``byte_level``: the vocabulary is one over
    bytes, so the text is encoded as it stands."""
    mid = model.token_to_id(marker)
    step = encode_byte_level if byte_level else encode
    ids = with_markers(step(F.col(text), model, max_ids=max_length - 1), mid, mid, max_length)
    return texts.select(key, ids.alias("ids"))
