"""Training-corpus pipeline: toxicity, language, near-duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.  All but the last
return the columns of ``docs`` unchanged; ``run`` writes every stage's result as Parquet in the shared
checkpoint folder and rereads it as the next stage's input, so a lost executor costs at most one stage's tasks.

Defined results: rows with a null or empty text are not toxic, but no language can be told (rejected by the
second stage); repeated rows are near-duplicates of each other (one stays); null ids go through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.llm import langid, packing, simhash, toxicity
from lexiframe.llm.common import fold, read, scratch_path

MIN_LANGUAGE_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier does not predict toxic.  It learns labels of rows outside the held-out fold."""
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit_toxicity(docs, labels, fold(F.col("doc_id"), 5) != 0)
    kept = toxicity.score_toxicity(_boxed(docs), model, text="_text", keep=("_row",))
    return kept.where(F.col("predicted") == 0).select("_row.*")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is identified with a posterior of at least ``MIN_LANGUAGE_SCORE``."""
    learn = docs.select("doc_id", F.col("text").alias("_text"), "lang")
    kept = langid.identify_languages(learn, fold(F.col("doc_id"), 4) != 2, _boxed(docs), text="_text", keep=("_row",))
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return kept.where(sure).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id (any one of equal rows)."""
    return simhash.one_per_class(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids."""
    return packing.pack_documents(docs, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("language", keep_identified), ("near_duplicates", drop_near_duplicates),
          ("packing", pack)]

#: Trained classifiers and sequence packing have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _boxed(docs: DataFrame) -> DataFrame:
    """``(doc_id, _text, _row)``: the whole row travels in one struct, so no column name can clash."""
    return docs.select("doc_id", F.col("text").alias("_text"), F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("_row"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
