"""Seeded shuffle, batching, padding, masks, shift, flatten, un-pad, cadence, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.functions.rows import posexplode_rows
from lexiframe.sources.corpus import hash_key

# Buckets per shuffle partition for the hash-ordered index (balance).
BUCKETS_PER_PARTITION = 16


def global_index(df: DataFrame, key: str | list[str], seed: int | None = 0, n_parts: int | None = None,
                 out: str = "idx") -> DataFrame:
    """Add ``idx`` (0-based) in the total order ``md5('<seed>:<key>'), key``
    (or plain key order when ``seed`` is None).  Keys must be unique.

    No one-partition window over rows, and no action while the plan is built.
    With a seed the order is a uniform hash, so the hash prefix gives buckets
    that are already in order: rows per bucket are counted on the key columns
    only (partial aggregation), and a running sum over that table, which has
    ``BUCKETS_PER_PARTITION`` rows per partition whatever the data, gives each
    bucket's offset.  The rows are hash-partitioned on the bucket and sorted
    inside partitions, and each row gets ``offset(bucket) + position`` from a
    broadcast join with the offsets.  Partitioning and sort are deterministic,
    so a partition recomputed after executor loss gets the same numbers.
    """
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if seed is None:
        return _ordered_index(df, keys, n, out)
    nb = n * BUCKETS_PER_PARTITION
    h = hash_key(seed, keys)
    bucket = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") * F.lit(nb) / F.lit(1 << 32)).cast("long")
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # the partition of a bucket is that of the row shuffle below
    own = Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = (df.select(bucket.alias("_b")).groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_p", F.pmod(F.hash(F.col("_b")), F.lit(n)))
               .withColumn("_all", F.coalesce(F.sum("_n").over(before), zero))
               .withColumn("_own", F.coalesce(F.sum("_n").over(own), zero))
               .select("_b", (F.col("_all") - F.col("_own")).alias("_delta")))
    pos = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    return (
        df.withColumn("_h", h).withColumn("_b", bucket)
        .repartition(n, "_b")
        .sortWithinPartitions("_b", "_h", *keys)
        .withColumn("_pos", pos)
        .join(F.broadcast(offsets), "_b")
        .withColumn(out, (F.col("_pos") + F.col("_delta")).cast("long"))
        .drop("_h", "_b", "_pos", "_delta")
    )


def _ordered_index(df: DataFrame, keys: list[str], n: int, out: str) -> DataFrame:
    """Key-order index: range partitions (sampled bounds), written once to the
    checkpoint folder with partition id and position so counting and numbering
    see the same partitions; per-partition counts give broadcast offsets."""
    from lexiframe.session import scratch_path

    spark = df.sparkSession
    path = scratch_path(spark, "index")
    (df.repartitionByRange(n, *keys)
       .sortWithinPartitions(*keys)
       .withColumn("_pid", F.spark_partition_id())
       .withColumn("_mid", F.monotonically_increasing_id())
       .write.parquet(path))
    ranged = spark.read.parquet(path)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    idx = F.col("_off") + (F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, idx.cast("long")).drop("_pid", "_mid", "_off"))


def next_row(df: DataFrame, group: str, order: str, cols: list[str], prefix: str = "next_") -> DataFrame:
    """Add the values of ``cols`` from the next row of the same ``group`` in
    ``order`` (like ``lead``), without a window partitioned by the group.

    A window would put a whole group into one task; here rows are numbered in
    ``(group, order)`` order by range partitions (a hot group is split across
    partitions because the order column breaks it up), then each row meets its
    successor through an equi-join on the row number (unique keys, no skew).
    The group/order pair must be unique.
    """
    idx = global_index(df, [group, order], seed=None, out="_row")
    succ = idx.select((F.col("_row") - 1).alias("_row"), F.col(group).alias("_g"),
                      *[F.col(c).alias(prefix + c) for c in cols])
    out = idx.join(succ, "_row", "left")
    same = F.col("_g") == F.col(group)
    for c in cols:
        out = out.withColumn(prefix + c, F.when(same, F.col(prefix + c)))
    return out.drop("_row", "_g")


def assign_batches(df: DataFrame, key: str | list[str], batch_size: int = 64, seed: int = 0) -> DataFrame:
    """Shuffle by seed, then ``batch_id = idx div batch_size``, ``slot = idx mod batch_size``.
    The last partial batch is kept."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    return (global_index(df, key, seed)
            .withColumn("batch_id", F.floor(F.col("idx") / batch_size).cast("long"))
            .withColumn("slot", (F.col("idx") % batch_size).cast("int")))


def pad_to(ids: Column, length: Column, pad_id: int) -> Column:
    n = F.size(ids)
    return F.concat(ids, F.array_repeat(F.lit(pad_id), F.greatest(length - n, F.lit(0))))


def mask_of(ids: Column, length: Column) -> Column:
    n = F.size(ids)
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.greatest(length - n, F.lit(0))))


def batch_max_length(df: DataFrame, ids_cols: list[str], batch_col: str = "batch_id") -> DataFrame:
    """Longest sequence per batch for each id column; partial aggregation keeps it small."""
    return df.groupBy(batch_col).agg(*[F.max(F.size(c)).alias(f"_len_{c}") for c in ids_cols])


def pad_batches(df: DataFrame, ids_cols: list[str], pad_id: int, batch_col: str = "batch_id",
                mask_suffix: str = "_attention_mask", by_batch: bool = False) -> DataFrame:
    """Right-pad every id array to the longest in its batch; add the attention masks.

    Each id column is padded on its own (source and target independently).
    The per-batch lengths are a table of one row per batch, joined on the
    batch; Spark picks the join from its size at run time.  ``by_batch``: deal the rows by batch instead and
    take the lengths there (a batch is ``batch_size`` rows), for steps that need whole batches anyway.
    """
    if by_batch:
        own = Window.partitionBy(batch_col)
        out = df.repartition(batch_col).select("*", *[F.max(F.size(c)).over(own).alias(f"_len_{c}") for c in ids_cols])
    else:
        out = df.join(batch_max_length(df, ids_cols, batch_col), batch_col)
    for c in ids_cols:
        L = F.col(f"_len_{c}")
        out = out.withColumn(f"{c}{mask_suffix}", mask_of(F.col(c), L)) \
                 .withColumn(c, pad_to(F.col(c), L, pad_id))
    return out.drop(*[f"_len_{c}" for c in ids_cols])


def collate(df: DataFrame, cols: list[str], batch_col: str = "batch_id", slot_col: str = "slot") -> DataFrame:
    """One row per batch: arrays of the sequences in slot order."""
    st = F.sort_array(F.collect_list(F.struct(F.col(slot_col), *[F.col(c) for c in cols])))
    return df.groupBy(batch_col).agg(st.alias("_rows")).select(
        batch_col, *[F.col("_rows")[c].alias(c) for c in [slot_col] + cols]
    )


def shift(ids: Column, mask: Column) -> dict[str, Column]:
    """Next-token shift of padded arrays: inputs drop the last column, labels the first."""
    n = F.size(ids)
    m = F.greatest(n - 1, F.lit(0))
    return {
        "input_ids": F.slice(ids, 1, m),
        "input_mask": F.slice(mask, 1, m),
        "labels": F.slice(ids, 2, m),
        "labels_mask": F.slice(mask, 2, m),
    }


def flatten_tokens(df: DataFrame, keys: list[str], labels: str = "labels",
                   labels_mask: str = "labels_mask") -> DataFrame:
    """One row per token position: ``(keys..., pos, label, mask)`` (narrow)."""
    z = F.arrays_zip(F.col(labels).alias("label"), F.col(labels_mask).alias("mask"))
    return posexplode_rows(df, z, "pos", "_z", *keys).select(
        *keys, "pos", F.col("_z.label").alias("label"), F.col("_z.mask").alias("mask")
    )


def unpad(ids: Column, mask: Column) -> Column:
    """Keep the ids whose mask is 1 (mask-driven, not length-driven).  The mask is evaluated once a row: inside a
    lambda an expression that makes it would run for every element."""
    pairs = F.arrays_zip(ids.alias("id"), F.slice(mask, 1, F.size(ids)).alias("m"))
    kept = F.transform(F.filter(pairs, lambda z: z["m"] == 1), lambda z: z["id"])
    return F.coalesce(kept, F.slice(ids, 1, 0))  # no mask: nothing is kept


def real_length(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, v: a + v)


def last_real_position(mask: Column) -> Column:
    return real_length(mask) - 1


def clip(ids: Column, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def grow(ids: Column, pad_id: int, k: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad_id), k))


def cadence(df: DataFrame, eval_steps: int, batch_size: int, batch_col: str = "batch_id") -> DataFrame:
    """Batches at which evaluation/checkpointing happens, with ``step = batch * batch_size``."""
    every = eval_steps // batch_size
    if every <= 0:
        raise ValueError("eval_steps must be at least batch_size")
    return df.where(F.col(batch_col) % every == 0).withColumn(
        "step", (F.col(batch_col) * batch_size).cast("long"))


def resume_from(df: DataFrame, next_batch: int, batch_col: str = "batch_id") -> DataFrame:
    """Skip batches below the stored position (correct because the shuffle is reproducible)."""
    return df.where(F.col(batch_col) >= F.lit(int(next_batch)))
