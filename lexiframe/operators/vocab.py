"""Word counts, alphabet, special tokens, pair counts, vocabulary lookups."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiframe.functions.rows import explode_rows, posexplode_rows
from lexiframe.functions.text import SPECIAL_TOKENS, words

VOCAB_SCHEMA = "token string, id int, kind string"
MERGES_SCHEMA = "rank int, left string, right string, merged string"


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` over the normalised pre-tokens of every text.

    explode -> hash aggregate with a map-side partial count, so a hot word is
    combined inside each task before the shuffle.
    """
    return (explode_rows(texts, words(F.col(text)), "word")
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def chars(word: Column) -> Column:
    """Code points of a string (surrogate pairs stay whole)."""
    return F.regexp_extract_all(word, F.lit("(?s)."), 0)


def specials_frame(spark: SparkSession, specials: list[str] | None = None) -> DataFrame:
    specials = SPECIAL_TOKENS if specials is None else specials
    return spark.createDataFrame([(t, i, "special") for i, t in enumerate(specials)], VOCAB_SCHEMA)


def alphabet(word_table: DataFrame, word: str = "word", first_id: int = len(SPECIAL_TOKENS),
             specials: list[str] | None = None) -> DataFrame:
    """Distinct characters of the words, numbered by code point after the specials.

    The distinct step is a partial+final aggregate; the numbering window runs
    over the alphabet only (bounded by the size of Unicode).  A character that
    equals a special token is not added twice.
    """
    specials = SPECIAL_TOKENS if specials is None else specials
    distinct = (explode_rows(word_table, chars(F.col(word)), "token").distinct()
                .where(~F.col("token").isin(specials)))
    w = Window.orderBy("token")  # UTF-8 byte order = code point order
    return distinct.select(
        "token", (F.row_number().over(w) + F.lit(first_id - 1)).cast("int").alias("id"),
        F.lit("alphabet").alias("kind"))


def char_vocab(texts: DataFrame, text: str = "text", specials: list[str] | None = None) -> DataFrame:
    """Specials + alphabet of the normalised words (a vocabulary without merges)."""
    specials = SPECIAL_TOKENS if specials is None else specials
    spark = texts.sparkSession
    wc = word_counts(texts, text)
    return specials_frame(spark, specials).unionByName(alphabet(wc, specials=specials, first_id=len(specials)))


def string_pair_counts(word_table: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """Character-pair counts of a ``(word, n)`` table: ``(left, right, n)`` as strings."""
    c = chars(F.col(word))
    k = F.size(c) - 1
    pairs = F.when(k <= 0, F.array().cast("array<struct<l:string,r:string>>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))),
                    lambda i: F.struct(F.element_at(c, i).alias("l"), F.element_at(c, i + 1).alias("r"))))
    return (explode_rows(word_table, pairs, "_p", F.col(n).alias("_w"))
            .groupBy(F.col("_p.l").alias("left"), F.col("_p.r").alias("right"))
            .agg(F.sum("_w").cast("long").alias("n")))


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size"))


def token_ids(tokens: DataFrame, vocab: DataFrame, token: str = "token", unk_id: int = 0) -> DataFrame:
    """token -> id (unknown -> ``unk_id``).  Spark picks the join from the sizes at run time."""
    v = vocab.select(F.col("token").alias(token), F.col("id").alias("_id"))
    return tokens.join(v, token, "left").withColumn(
        "id", F.coalesce(F.col("_id"), F.lit(unk_id))).drop("_id")


def ids_to_tokens(seqs: DataFrame, vocab: DataFrame, key: str, ids: str = "ids",
                  remove_id: int | None = None, out: str = "tokens") -> DataFrame:
    """id arrays -> token arrays, dropping every ``remove_id`` (e.g. EOS).

    The sequences are exploded with their positions, joined to the
    vocabulary and re-assembled in position
    order per key; a group is one sequence.
    """
    arr = F.col(ids)
    if remove_id is not None:
        arr = F.array_remove(arr, F.lit(remove_id))
    v = vocab.select(F.col("id").alias("_tid"), F.col("token").alias("_tok"))
    exploded = posexplode_rows(seqs, arr, "_pos", "_tid", key)
    joined = exploded.join(v, "_tid", "left")
    back = joined.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("_pos", "_tok"))).alias("_s"))
    return seqs.join(back.select(key, F.col("_s._tok").alias(out)), key, "left").withColumn(
        out, F.coalesce(F.col(out), F.array().cast("array<string>")))


def ids_to_tokens_col(ids: Column, tokens: list[str], remove_id: int | None = None) -> Column:
    """Column form of id -> token for a dense vocabulary (ids 0..V-1): narrow, no join.  The table is one
    literal, folded from JSON when the plan is optimised, so its size does not grow the plan."""
    table = F.from_json(F.lit(json.dumps(tokens)), "array<string>")
    arr = F.array_remove(ids, F.lit(remove_id)) if remove_id is not None else ids
    return F.transform(arr, lambda i: F.get(table, i))
