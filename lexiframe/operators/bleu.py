"""Corpus BLEU (Papineni et al. 2002): per-row statistics, then one small sum.

Semantics of the corpus-level score the reference reports: per hypothesis and
order n, clipped n-gram matches against the maximum count over its
references; the denominator of a hypothesis is ``max(1, #n-grams)``; sums over
the corpus; brevity penalty from summed hypothesis lengths and summed closest
reference lengths (ties to the shorter); 0 when no unigram matches; an order
with no match contributes the smallest positive double (no smoothing).

A hypothesis and its references share one row, so its n-grams are counted
within the row, by array operations over a slice of a batch: nothing but four numbers per order is ever shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.functions.rows import row_slices

# Uniform weights over orders 1..4; the value an order without
# any match contributes instead of zero (smallest positive normal double).
DEFAULT_WEIGHTS = (0.25, 0.25, 0.25, 0.25)
ZERO_MATCH_VALUE = sys.float_info.min
_SLICE_WORDS = 1 << 19


def _grams(tokens: np.ndarray, owner: np.ndarray, orders: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order the n-grams that lie within one owner, as dense numbers, and their owners.  An n-gram is numbered by
    the (n-1)-gram it begins with and its last token, so numbers are equal only for equal n-grams."""
    grams, width = tokens.astype(np.int64), int(tokens.max(initial=0)) + 1
    for n in range(1, orders + 1):
        if n > 1:
            grams = np.unique(grams[:-1] * width + tokens[n - 1:], return_inverse=True)[1] if len(grams) > 1 else grams[:0]
        k = len(grams)
        whole = owner[:k] == owner[n - 1:n - 1 + k]
        yield n, grams[whole], owner[:k][whole]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def batch_stats(hyps: pa.ListArray, refs: pa.ListArray, orders: int) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    """Clipped matches and denominators ``(row, order)``, and the lengths of each hypothesis and of its closest reference
    (None without one).  All rows of a batch at once."""
    rows = len(hyps)
    lens = lambda a: a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    each = refs.flatten()  # the references of all rows
    words = pa.chunked_array([hyps.flatten().cast(pa.string()), each.flatten().cast(pa.string())]).combine_chunks()
    tokens = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    h_len, r_len, of_row = lens(hyps), lens(each), np.repeat(np.arange(rows), lens(refs))
    # owners: the hypotheses are 0 .. rows-1, the references follow
    owner = np.repeat(np.arange(rows + len(each)), np.r_[h_len, r_len])
    row_of = np.r_[np.arange(rows), of_row]
    num = np.zeros((rows, orders), dtype=np.int64)
    for n, grams, own in _grams(tokens, owner, orders):
        width = int(grams.max(initial=0)) + 1
        is_hyp = own < rows
        h_keys, h_n = _counted(own[is_hyp] * width + grams[is_hyp])
        keys, counts = _counted(own[~is_hyp] * width + grams[~is_hyp])
        # the most that one reference of the row has of it
        keys = row_of[keys // width] * width + keys % width
        order = np.lexsort((-counts, keys))
        keys, counts = keys[order], counts[order]
        top = np.r_[True, keys[1:] != keys[:-1]][:len(keys)]
        keys, counts = keys[top], counts[top]
        if len(keys):
            at = np.minimum(np.searchsorted(keys, h_keys), len(keys) - 1)
            clipped = np.where(keys[at] == h_keys, np.minimum(h_n, counts[at]), 0)
            num[:, n - 1] = np.bincount(h_keys // width, weights=clipped, minlength=rows)
    den = np.maximum(h_len[:, None] - np.arange(orders), 1)
    near: list = [None] * rows
    for i, k in zip(of_row.tolist(), r_len.tolist()):  # closest reference length, ties to the shorter one
        if near[i] is None or (abs(k - h_len[i]), k) < (abs(near[i] - h_len[i]), near[i]):
            near[i] = k
    return num, den, near, h_len


def _row_words(hyps: pa.ListArray, refs: pa.ListArray) -> np.ndarray:
    """Tokens of each row, of the hypothesis and all references."""
    lens = lambda a: a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.r_[0, np.cumsum(lens(refs.flatten()))]
    n = lens(refs)
    return lens(hyps) + before[np.cumsum(n)] - before[np.cumsum(n) - n]


def sentence_stats(pairs: DataFrame, keys: str | tuple[str, ...] = "pair_id", hyp: str = "hyp", refs: str = "refs",
                   orders: int = 4) -> DataFrame:
    """Per hypothesis and order: clipped matches, denominator, lengths.  One
    Arrow-batched pass, no shuffle; null token arrays count as empty.  A batch is counted in slices of rows with about
    ``_SLICE_WORDS`` tokens, so that what is held beside a batch does not grow with it."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = pairs.select(*keys, hyp, refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in row_slices(_row_words(batch.column(len(keys)), batch.column(len(keys) + 1)), _SLICE_WORDS):
                b = batch.slice(start, stop - start)
                num, den, near, lens = batch_stats(b.column(len(keys)), b.column(len(keys) + 1), orders)
                at = pa.array(np.repeat(np.arange(b.num_rows), orders), pa.int64())
                cols = [pa.array(np.tile(np.arange(1, orders + 1), b.num_rows), pa.int32()),
                        pa.array(lens, pa.int32()).take(at), pa.array(near, pa.int32()).take(at),
                        pa.array(num.ravel(), pa.int64()), pa.array(den.ravel(), pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column(k).take(at) for k in range(len(keys))] + cols,
                                                 names=[*keys, "n", "hyp_len", "ref_len", "num", "den"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, n int, hyp_len int, ref_len int, num long, den long")


def pair_up(hyps: DataFrame, refs: DataFrame, on: tuple[str, ...] = ("batch_id", "slot"), hyp: str = "hyp",
            ref: str = "ref") -> DataFrame:
    """Generated and target sequences from two tables, paired by their place
    ``(batch_id, slot)``: ``(*on, hyp, refs)``.  A generated row without a
    target keeps an empty reference list."""
    r = refs.groupBy(*on).agg(F.collect_list(ref).alias("refs"))
    return (hyps.select(*on, F.col(hyp).alias("hyp")).join(r, list(on), "left")
            .withColumn("refs", F.coalesce("refs", F.array().cast(r.schema["refs"].dataType))))


def corpus_bleu(pairs: DataFrame, keys: str | tuple[str, ...] = "pair_id", hyp: str = "hyp", refs: str = "refs",
                weights: tuple[float, ...] = DEFAULT_WEIGHTS) -> DataFrame:
    """One row: ``bleu`` plus the per-order precisions and lengths."""
    orders = len(weights)
    per_n = sentence_stats(pairs, keys, hyp, refs, orders).groupBy("n").agg(
        F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("hyp_len").alias("c"), F.sum("ref_len").alias("r"))
    one = per_n.agg(*[
        F.max(F.when(F.col("n") == n, F.col(c))).alias(f"{c}{n}")
        for n in range(1, orders + 1) for c in ("num", "den")
    ], F.max("c").alias("c"), F.max("r").alias("r"))
    logs = None
    for n, w in enumerate(weights, start=1):
        p = F.when(F.col(f"num{n}") == 0, F.lit(ZERO_MATCH_VALUE)).otherwise(
            F.col(f"num{n}") / F.col(f"den{n}"))
        term = F.lit(w) * F.log(p)
        logs = term if logs is None else logs + term
    c, r = F.col("c").cast("double"), F.col("r").cast("double")
    bp = F.when(c > r, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.exp(1 - r / c))
    bleu = F.when(F.coalesce(F.col("num1"), F.lit(0)) == 0, F.lit(0.0)).otherwise(bp * F.exp(logs))
    return one.select(
        bleu.alias("bleu"), bp.alias("brevity_penalty"),
        *[F.try_divide(F.col(f"num{n}"), F.col(f"den{n}").cast("double")).alias(f"p{n}")
          for n in range(1, orders + 1)],
        F.col("c").alias("hyp_len"), F.col("r").alias("ref_len"),
    )
