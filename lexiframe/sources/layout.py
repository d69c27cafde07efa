"""Rows by position: a numbered layout that a request reads only in part.

Rows are numbered in key order and written in blocks of a set number of rows, one folder a block, so a row's number says
in which block it is.  A request for positions names its blocks, and partition pruning leaves the others unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.operators.batches import global_index

ROWS_PER_BLOCK = 1_000_000


def write_positions(df: DataFrame, path: str, key: str | list[str], rows_per_block: int = ROWS_PER_BLOCK,
                    mode: str = "errorifexists") -> str:
    """Write ``df`` with its 0-based ``row`` number in key order (keys must be unique), block by block."""
    numbered = global_index(df, key, seed=None, out="row")
    block = (F.col("row") / rows_per_block).cast("long")
    (numbered.withColumn("block", block).repartition("block").sortWithinPartitions("block", "row")
     .write.mode(mode).partitionBy("block").parquet(path))
    return path


def fetch_positions(spark: SparkSession, path: str, positions: DataFrame, row: str = "row",
                    rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Rows at the given positions (repeated positions give a row once; positions beyond the end give none).  The blocks
    asked for are at most as many as the layout has."""
    wanted = positions.select(F.col(row).cast("long").alias("row")).where(F.col("row").isNotNull())
    blocks = [r[0] for r in wanted.select((F.col("row") / rows_per_block).cast("long")).distinct().collect()]
    rows = spark.read.parquet(path)
    return rows.where(F.col("block").isin(blocks)).join(wanted, "row", "left_semi").drop("block")
