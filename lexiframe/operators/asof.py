"""As-of pairing: for each row the value that was last known at its place in an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, on: str, value: str, width: int, out: str | None = None) -> DataFrame:
    """The rows of ``left`` with ``out``: the ``value`` of the ``right`` row with the largest ``on`` that is not above
    theirs (null if there is none; of several such rows the largest value).

    No row is paired by comparison and no window spans the table: the order is cut into ranges of ``width``; within a
    range a running last value does it, and what a range takes over from earlier ones comes from a table with one
    row a range.  A null ``on`` has no place in the order and gets null.
    """
    out = out or value
    own = left.columns
    place = F.floor(F.col(on) / F.lit(width))
    rows = left.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(on).alias("_on"), place.alias("_range"),
                       F.lit(1).alias("_kind"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    known = (right.where(F.col(on).isNotNull() & F.col(value).isNotNull())
             .select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col(on).alias("_on"), place.alias("_range"),
                     F.lit(0).alias("_kind"), F.col(value).alias("_value")))
    every = rows.unionByName(known)
    latest = F.max(F.when(F.col("_kind") == 0, F.struct("_on", "_value")))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (every.where(F.col("_range").isNotNull()).groupBy("_range").agg(latest.alias("_last"))
              .select(F.col("_range").alias("_at"), F.last("_last", ignorenulls=True).over(earlier)["_value"].alias("_before")))
    within = (Window.partitionBy("_range").orderBy("_on", "_kind", "_value")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (every.withColumn("_seen", F.when(F.col("_on").isNotNull(), F.last("_value", ignorenulls=True).over(within)))
            .where(F.col("_kind") == 1).join(ranges, F.col("_range") == F.col("_at"), "left")
            .select(*[F.col("_row")[c].alias(c) for c in own], F.coalesce("_seen", "_before").alias(out)))
