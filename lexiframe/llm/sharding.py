"""Proportional stratified interleaving: shards that all have the corpus mixture.

Rows are put in a seeded pseudo-random order within their source and ranked;
row ``r`` of a source of ``n`` rows gets the fractional rank ``(2r+1)/(2n)``.
All rows, sorted by fractional rank, are cut into equal runs of positions, so
each shard holds every source in proportion, and shard sizes differ by at
most one row (law ``rows``).

Ranks and positions come from buckets, never from one window over a source or
over the table: the seeded order is a uniform hash, so its top bits are ordered
buckets of about ``bucket_rows`` rows; a small table of bucket counts gives
each bucket's offset, and a window numbers rows only within a bucket.  A
source with a third of all rows is spread over its buckets.  The fractional
rank is handled the same way, and where many rows share one rank (all sources
of one row have the rank 1/2), that rank is a run of buckets of its own, cut
by the top bits of the seeded order that ties are in anyway.

Defined results: a null text counts as empty, null sources are a source of
their own, rows that are equal in every way take neighbouring ranks in any
order, texts of any length count whole, an empty table gives an empty result.  The order depends on the seed
and the row alone, so a recomputed task gets the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_SHARDS = 24
SEED = 20240
BUCKET_ROWS = 8192


def _offsets(rows: DataFrame, group: list[str], bucket: str, number: Column | None = None) -> DataFrame:
    """Rows before each bucket within its group, and the group's size.  Two levels of running sums (buckets within chunks of
    1024 by their ``number``, then chunks), so that no window holds more than a thousandth of the buckets of a group."""
    counts = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_chunk", F.floor((F.col(bucket) if number is None else number) / 1024))
    inner = Window.partitionBy(*group, "_chunk").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    chunks = counts.groupBy(*group, "_chunk").agg(F.sum("_n").alias("_cn"))
    chunks = (chunks.withColumn("_before", F.coalesce(F.sum("_cn").over(outer), F.lit(0)))
              .withColumn("_size", F.sum("_cn").over(Window.partitionBy(*group))).drop("_cn"))
    return (within.join(chunks, [*group, "_chunk"])
            .select(*group, bucket, (F.col("_in") + F.col("_before")).alias("_off"), "_size"))


def _rank_buckets(frac: DataFrame, n_buckets: int, bucket_rows: int) -> DataFrame:
    """Adds ``_fb``, an ordered bucket ``(range of ranks, place among its hot ranks, part)``.  A rank with more than
    ``bucket_rows`` rows is hot: it stands between the other rows of its range, cut by the seeded order."""
    rng = F.least(F.floor(F.col("_f") * n_buckets), F.lit(n_buckets - 1)).cast("long")
    frac = frac.withColumn("_rng", rng)
    # a range has at most rows / bucket_rows hot ranks
    hot = (frac.groupBy("_rng", "_f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
           .groupBy("_rng").agg(F.collect_list(F.struct("_f", "n")).alias("_hot")))
    frac = frac.join(hot, "_rng", "left")
    below = F.coalesce(F.size(F.filter("_hot", lambda h: h["_f"] < F.col("_f"))), F.lit(0))
    same = F.get(F.filter("_hot", lambda h: h["_f"] == F.col("_f")), F.lit(0))["n"]
    parts = F.ceil(same / bucket_rows).cast("long")
    part = F.when(same.isNotNull(), F.shiftright(F.shiftright("_h", 31) * parts, 31)).otherwise(F.lit(0))
    place = 2 * below + F.when(same.isNotNull(), 1).otherwise(0)
    return frac.withColumn("_fb", F.struct(F.col("_rng").alias("r"), place.alias("p"), part.cast("long").alias("h"))).drop("_rng", "_hot")


def stratified_shards(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED, key: str = "doc_id",
                      text: str = "text", source: str = "source", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(key, stratum, size, text_crc32, position, shard, slot)`` for every row of ``docs``."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    body = F.coalesce(F.col(text), F.lit(""))
    stratum: Column = F.concat(F.when(F.col(source).isNull(), "0").otherwise("1"), F.coalesce(F.col(source), F.lit("")))
    rows = docs.select(
        F.col(key), stratum.alias("stratum"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"))
    # 62 uniform bits, non-negative
    rows = rows.withColumn("_h", F.shiftrightunsigned(
        F.xxhash64(F.lit(seed), F.col(key), F.col("text_crc32"), F.col("size")), 2))
    total = rows.count()
    n_buckets = max(1, -(-total // bucket_rows))
    order = ["_h", key, "text_crc32", "size"]

    # the bits are cut at 31, so that the product stays in 64 bits
    ranked = rows.withColumn("_b", F.shiftright(F.shiftright("_h", 31) * F.lit(n_buckets), 31))
    in_bucket = F.row_number().over(Window.partitionBy("stratum", "_b").orderBy(*order)) - 1
    frac = (ranked.withColumn("_r", in_bucket)
            .join(_offsets(ranked, ["stratum"], "_b"), ["stratum", "_b"])
            .withColumn("_f", (2 * (F.col("_r") + F.col("_off")) + 1) / (2 * F.col("_size")))
            .drop("_b", "_r", "_off", "_size"))

    frac = _rank_buckets(frac, n_buckets, bucket_rows).withColumn("_one", F.lit(0))
    w = Window.partitionBy("_one", "_fb").orderBy("_f", *order, "stratum")
    placed = (frac.withColumn("_r", F.row_number().over(w) - 1)
              .join(_offsets(frac, ["_one"], "_fb", F.col("_fb.r")), ["_one", "_fb"])
              .withColumn("position", (F.col("_r") + F.col("_off")).cast("long")))
    # shard s takes the positions p with floor(p * n_shards / total) = s
    shard = F.expr(f"position * {int(n_shards)} div {max(total, 1)}").cast("int")
    placed = placed.withColumn("shard", shard)
    first = F.expr(f"(shard * {total}L + {int(n_shards) - 1}) div {int(n_shards)}")
    return placed.withColumn("slot", F.col("position") - first).select(
        key, F.when(F.col("stratum").startswith("1"), F.substring("stratum", 2, 2**30)).alias("stratum"),
        "size", "text_crc32", "position", "shard", F.col("slot").cast("long").alias("slot"))
