"""Column functions over score arrays: softmax, argmax, log-sum-exp, cross entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double_array(z: Column) -> Column:
    return z.cast("array<double>")


def logsumexp(z: Column) -> Column:
    """``m + log(sum(exp(v - m)))`` with ``m = max(z)`` (stable)."""
    m = F.array_max(z)
    return m + F.log(F.aggregate(z, F.lit(0.0).cast("double"), lambda a, v: a + F.exp(v - m)))


def softmax(z: Column) -> Column:
    m = F.array_max(z)
    s = F.aggregate(z, F.lit(0.0).cast("double"), lambda a, v: a + F.exp(v - m))
    return F.transform(z, lambda v: F.exp(v - m) / s)


def argmax(z: Column) -> Column:
    """0-based position of the largest score; the first one on ties."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def array_mean(z: Column) -> Column:
    return F.aggregate(z, F.lit(0.0).cast("double"), lambda a, v: a + v) / F.size(z)


def cross_entropy(z: Column, label: Column, smoothing: float = 0.0) -> Column:
    """Per-row cross entropy of logits ``z`` against an integer ``label``.

    With ``smoothing`` e: ``(1-e)*nll + e*(lse - mean(z))`` (uniform target mass).
    The label indexes the array; the logits are never one-hot expanded.
    """
    lse = logsumexp(z)
    nll = lse - F.get(z, label)
    if smoothing == 0.0:
        return nll
    return (1.0 - smoothing) * nll + smoothing * (lse - array_mean(z))
