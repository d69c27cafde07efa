"""Vector lookup and positional features as column operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.functions.rows import explode_rows
from lexiframe.session import materialize

BROADCAST_BYTES = 16 << 20


def positional_value(pos: Column, dim: Column, d_model: int) -> Column:
    """sin for even dims, cos for odd dims, of ``pos / 10000^(dim/d_model)``
    (every dim has its own frequency, odd ones included)."""
    arg = pos.cast("double") / F.pow(F.lit(10000.0), dim.cast("double") / F.lit(float(d_model)))
    return F.when(dim % 2 == 0, F.sin(arg)).otherwise(F.cos(arg))


def positional_vector(pos: Column, d_model: int) -> Column:
    """The positional feature vector of one position, computed in place (no table, no join)."""
    return F.transform(F.sequence(F.lit(0), F.lit(d_model - 1)), lambda d: positional_value(pos, d, d_model))


def positional_table(spark, max_len: int, d_model: int) -> DataFrame:
    """``(pos, dim, value)`` for every cell; a flat range, no cross join."""
    r = spark.range(max_len * d_model)
    pos = (F.col("id") / d_model).cast("long")
    dim = (F.col("id") % d_model).cast("long")
    return r.select(pos.alias("pos"), dim.alias("dim"), positional_value(pos, dim, d_model).alias("value"))


def lookup_vectors(tokens: DataFrame, vectors: DataFrame, token_col: str = "token_id",
                   id_col: str = "id", vec_col: str = "vector", salts: int | None = None) -> DataFrame:
    """Equi-join token rows with a vector table.  A token without a vector
    keeps its row, with a null vector, so nothing is lost silently
    (``count_if(vector is null)`` tells how many).

    Hot ids are split: ids with more than ``1 / (4 * partitions)`` of all tokens are at most ``4 * partitions``, a
    bound that lets their list be broadcast.  A hot id's tokens are dealt to ``salts`` join keys by a hash of the row
    and its vector is repeated for each; all others keep one key.

    Only vectors that a token asks for take part.  Up to ``BROADCAST_BYTES`` of them (a vocabulary's, whatever
    the number of tokens) are broadcast, so that no token is shuffled.  The tokens are read twice: pass rows that are cheap to read.
    """
    n = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = salts or n
    # counted once, one row an id; read for the vectors asked for, the total and the hot ids
    counts = materialize(tokens.where(F.col(token_col).isNotNull()).groupBy(F.col(token_col).alias("_hot"))
                         .agg(F.count(F.lit(1)).alias("_n")), "token-counts")
    v = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias(vec_col))
    asked = materialize(v.join(counts, F.col("_id") == F.col("_hot"), "leftsemi"), "vectors-asked")
    size = asked.agg(F.sum(8 * F.greatest(F.size(vec_col), F.lit(0)) + 16).alias("b")).first()["b"] or 0
    if size <= BROADCAST_BYTES:
        return tokens.join(F.broadcast(asked), F.col(token_col) == F.col("_id"), "left").drop("_id")
    total = counts.agg(F.sum("_n").alias("t")).select("t").scalar()
    hot = F.broadcast(counts.where(F.col("_n") * F.lit(4 * n) > total).select("_hot"))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*tokens.columns), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    dealt = tokens.join(hot, F.col(token_col) == F.col("_hot"), "left").select(*tokens.columns, salt.alias("_salt"))
    copies = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    v = explode_rows(asked.join(hot, F.col("_id") == F.col("_hot"), "left"), copies, "_part", "_id", vec_col)
    return (dealt.join(v, (F.col(token_col) == F.col("_id")) & (F.col("_salt") == F.col("_part")), "left")
            .drop("_salt", "_part", "_id"))


def add_positions(vec: Column, pos: Column, d_model: int) -> Column:
    """Column form: computes the position features in place (use for few rows)."""
    return F.zip_with(vec, positional_vector(pos, d_model), lambda a, b: a + b)


def with_positions(df: DataFrame, vec_col: str, pos_col: str, d_model: int, max_len: int,
                   out: str | None = None) -> DataFrame:
    """Add position features to a vector column by a broadcast join with the
    ``max_len`` x ``d_model`` feature table (one row per position; bounded by
    the model's context length, not by the data), so sin/cos run once per
    position instead of once per token."""
    spark = df.sparkSession
    table = (positional_table(spark, max_len, d_model)
             .groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("_pe"))
             .select(F.col("pos").cast("int").alias("_ppos"), F.col("_pe.value").alias("_pe")))
    j = df.join(F.broadcast(table), F.col(pos_col).cast("int") == F.col("_ppos"), "left")
    return j.withColumn(out or vec_col, F.zip_with(F.col(vec_col), F.col("_pe"), lambda a, b: a + b)) \
            .drop("_ppos", "_pe")
