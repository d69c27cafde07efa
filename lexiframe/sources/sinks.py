"""Sinks: line exports, prepared datasets, tokenizer tables, run records, progress."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.functions.text import non_blank


def bilingual_lines(rows: DataFrame, pair: str, key: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """Per row: the first language's line, then the second's (pair order, not
    source/target order).  ``side`` keeps the order within a row."""
    lang1, lang2 = pair.split("-")
    return rows.select(
        *key,
        F.posexplode(F.array(F.col("translation")[lang1], F.col("translation")[lang2])).alias("side", "value"),
    )


def export_lines(lines: DataFrame, path: str, order: list[str] | None = None,
                 mode: str = "ignore") -> str:
    """Write a ``value`` column as text.  ``mode='ignore'`` skips an existing
    target; the path is returned in both cases."""
    out = lines
    if order:
        # range-partition then sort inside partitions: file order = key order,
        # without funnelling through one task
        out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    out.select("value").write.mode(mode).text(path)
    return path


def export_text_rows(texts: DataFrame, path: str, text: str = "text",
                     order: list[str] | None = None, mode: str = "ignore") -> str:
    """Text export that skips blank rows (whitespace-only, Unicode aware)."""
    kept = texts.where(non_blank(F.col(text))).withColumnRenamed(text, "value")
    return export_lines(kept, path, order=order, mode=mode)


def save_prepared(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Persist all splits, one folder per split (partition pruning on read)."""
    df.write.mode(mode).partitionBy("split").parquet(path)
    return path


def save_tokenizer(vocab: DataFrame, merges: DataFrame, path: str, mode: str = "errorifexists") -> str:
    vocab.write.mode(mode).parquet(f"{path}/vocab")
    merges.write.mode(mode).parquet(f"{path}/merges")
    return path


def load_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges")


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Run records (args, history, results) as JSON lines."""
    df.write.mode(mode).json(path)
    return path


def save_args(spark: SparkSession, args: dict, path: str, mode: str = "errorifexists") -> str:
    """A run's arguments as text, one ``name: value`` line each, by name."""
    lines = [(f"{k}: {json.dumps(v, ensure_ascii=False, default=str)}",) for k, v in sorted(args.items())]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode(mode).text(path)
    return path


def load_args(spark: SparkSession, path: str) -> dict:
    """What ``save_args`` wrote."""
    lines = [r[0].split(": ", 1) for r in spark.read.text(path).collect()]
    return {k: json.loads(v) for k, v in lines}


def save_progress(spark: SparkSession, path: str, run_id: str, next_batch: int) -> None:
    """Append a progress marker ``(run_id, next_batch)`` with the time it was made."""
    spark.createDataFrame([(run_id, int(next_batch))], "run_id string, next_batch long") \
        .withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(path)


def load_progress(spark: SparkSession, path: str, run_id: str) -> int:
    """The run's last stored position, even if it is lower than an earlier one; 0 when nothing was stored
    (a path that does not exist).  Any other read error is raised."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return 0
    row = (spark.read.parquet(path).where(F.col("run_id") == run_id)
           .agg(F.max_by("next_batch", "saved_at").alias("b")).first())
    return int(row["b"]) if row["b"] is not None else 0
