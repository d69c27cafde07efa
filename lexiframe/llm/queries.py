"""Registered queries of the pipeline operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.llm import compression, langid, lm, neighbours, oracles, packing, pieces, quality, repair, sharding, \
    simhash, spelling, toxicity, urls
from lexiframe.llm.common import fold, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages", "page_id", "url"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.stratified_shards(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score_documents(read(spark, sf_dir, "documents", "doc_id", "text"), fold(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = langid.identify_languages(docs, fold(F.col("doc_id"), 4) != 2)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "margin")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"), fold(F.col("doc_id"), 5) != 0)
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    forest = quality.fit_quality(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.judge_quality(docs, forest)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours.nearest(table, F.col("id") % 20 == 0)


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_sampled(read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return repair.repair_digests(rows, repair.repair_plans(rows)).withColumnRenamed("conv", "conv_id")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(read(spark, sf_dir, "documents", "doc_id", "text")))


def op13_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = compression.fit_compression(docs, read(spark, sf_dir, "labels", "doc_id", "quality"), fold(F.col("doc_id"), 5) != 0)
    out = compression.score_compression(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_packing, op2_simhash, op3_url_filter, op4_sharding, op5_lm_scoring, op6_language_id,
                                    op7_toxicity, op8_quality_rules, op9_nearest_neighbours, op10_piece_sampling,
                                    op11_conversation_repair, op12_spelling_variants, op13_compression_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": urls.oracle_sql(), "op11_conversation_repair": oracles.REPAIR,
            "op12_spelling_variants": oracles.SPELLING}
