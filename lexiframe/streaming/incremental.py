"""Incremental corpus preparation with Structured Streaming.

New parquet files under a source folder are filtered, normalised and
pre-tokenized (stateless steps only) and appended to a parquet sink exactly
once; the checkpoint location stores the position, so a restart continues
where the last run stopped.  Batching/padding is not offered on streams: a
global seeded shuffle has no streaming meaning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiframe.functions.text import non_blank, normalize, pretokenize
from lexiframe.sources.sinks import load_progress, save_progress


def prepare_text(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stateless preparation: drop blank rows, normalise, count pre-tokens."""
    norm = normalize(F.col(text))
    return (rows.where(non_blank(F.col(text)))
            .select(key, norm.alias("norm_text"))
            .select(key, "norm_text", F.size(pretokenize(F.col("norm_text"))).cast("long").alias("n_words")))


def run_incremental(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str,
                    transform: Callable[[DataFrame], DataFrame] = prepare_text,
                    max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Process everything new under ``source`` and stop (``availableNow``)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source)
    q = (transform(stream).writeStream.format("parquet")
         .option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def run_marked(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, progress: str, run_id: str = "stream",
               transform: Callable[[DataFrame], DataFrame] = prepare_text, max_files_per_trigger: int | None = None,
               mark: Callable[[int], None] | None = None) -> StreamingQuery:
    """Like ``run_incremental``, with the position in a progress table that other steps read (``load_progress``).

    Each micro-batch has a folder of its own, named by its number, that a rerun writes anew, and the marker follows the
    data: killed between the two, the next run writes that batch again into the same folder; a batch whose
    marker is there is skipped.  Either way every row is there once.
    """
    def write(rows: DataFrame, batch: int) -> None:
        if load_progress(spark, progress, run_id) > batch:
            return
        transform(rows).write.mode("overwrite").parquet(f"{sink}/micro_batch={batch}")
        (mark or (lambda b: save_progress(spark, progress, run_id, b + 1)))(batch)

    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (reader.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
