"""Corpus scans: text rows, paragraph rows, parallel rows, line files, splits, info."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.session import table_path

SPLITS = ("train", "validation", "test")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id long, text string)`` rows of the documents table."""
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def paragraph_rows(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line of each text: ``(key, para, text)``; narrow, no shuffle."""
    from lexiframe.functions.rows import posexplode_rows

    return posexplode_rows(texts, F.split(F.col(text), "\n", -1), "para", text, key)


def parallel_rows(spark: SparkSession, sf_dir: str,
                  src_lang: str = "user", tgt_lang: str = "assistant") -> DataFrame:
    """Parallel rows from conversations: a user turn and the turn right after it
    when that one is the assistant's (``lead`` over ``conv_id`` by ``turn``).

    ``translation`` is a struct with one field per side (pruned column-wise
    by Parquet, unlike a map).  Only ids and roles go through the index that
    finds the next turn (a long conversation is split over many tasks); the
    two texts are then fetched by their unique ``(conv_id, turn)``.
    """
    from lexiframe.operators.batches import next_row

    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pairs = next_row(conv.drop("text"), "conv_id", "turn", ["role", "turn"]).where(
        (F.col("role") == "user") & (F.col("next_role") == "assistant")).select("conv_id", "turn", "next_turn")
    src = conv.select("conv_id", "turn", F.col("text").alias("_src"))
    tgt = conv.select("conv_id", F.col("turn").alias("next_turn"), F.col("text").alias("_tgt"))
    return pairs.join(src, ["conv_id", "turn"]).join(tgt, ["conv_id", "next_turn"]).select(
        "conv_id", "turn", F.struct(F.col("_src").alias(src_lang), F.col("_tgt").alias(tgt_lang)).alias("translation"))


def project_pair(rows: DataFrame, pair: str, source_lang: str | None = None,
                 target_lang: str | None = None, keys: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """Language-pair projection: ``pair='a-b'`` -> source a, target b unless overridden."""
    first, second = pair.split("-")
    src = source_lang or first
    tgt = target_lang or second
    return rows.select(*keys,
                       F.col("translation")[src].alias("source"),
                       F.col("translation")[tgt].alias("target"))


def hash_key(seed: int | str, key: str | list[str]) -> F.Column:
    """Hex md5 of ``'<seed>:<key>[:<key2>...]'``; the same in any engine."""
    keys = [key] if isinstance(key, str) else list(key)
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _hex_threshold(fraction: float) -> str:
    return format(min(int(round(fraction * 65536)), 65535), "04x")


def assign_split(df: DataFrame, key: str, seed: int = 0,
                 fractions: tuple[float, float] = (0.9, 0.05)) -> DataFrame:
    """Add ``split`` in {train, validation, test} from the md5 of the key (no shuffle)."""
    h = F.substring(hash_key(seed, key), 1, 4)
    t1 = _hex_threshold(fractions[0])
    t2 = _hex_threshold(fractions[0] + fractions[1])
    return df.withColumn(
        "split",
        F.when(h < F.lit(t1), "train").when(h < F.lit(t2), "validation").otherwise("test"),
    )


def select_split(df: DataFrame, split: str) -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    return df.where(F.col("split") == split)


def read_prepared(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """Scan a dataset written with ``partitionBy('split')``; the split is pruned at planning."""
    return spark.read.parquet(path).where(F.col("split") == split)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Line-text scan of one or several files: a single ``value`` column."""
    return spark.read.text(paths if isinstance(paths, list) else [paths])


def dataset_length(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def fetch_rows(df: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``index`` (many-row form of get-item): a left-semi join."""
    return df.join(index.select(key), on=key, how="left_semi")


def dataset_info(df: DataFrame, text: str = "text", by: str | None = "split") -> DataFrame:
    """Per split: rows, total/avg/max characters (a description as a DataFrame)."""
    n = F.char_length(F.col(text))
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(n).alias("n_chars"),
        F.round(F.avg(n), 6).alias("avg_chars"),
        F.max(n).alias("max_chars"),
    ]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def dataset_columns(df: DataFrame) -> DataFrame:
    """``(position, name, type, n_rows, n_nulls)`` of every column, in one aggregation."""
    fields = df.schema.fields
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"_{i}")
                                                for i, f in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"),
                              F.lit(f.dataType.simpleString()).alias("type"), F.col("n").alias("n_rows"),
                              F.col(f"_{i}").alias("n_nulls")) for i, f in enumerate(fields)])
    return one.select(F.inline(rows))
