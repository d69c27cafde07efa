"""Row-generating helpers.

``explode``/``posexplode`` make the optimizer infer ``size(arr) > 0`` and push
it down, which evaluates the array expression a second time (below an
exchange, even a Python UDF).  The outer variants infer nothing; the one row
an empty or null array yields is dropped by a filter on the generator's own
output, which cannot move below the generator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, arr: Column, name: str, *keep) -> DataFrame:
    """One row per element of ``arr`` (elements must not be null)."""
    return df.select(*keep, F.explode_outer(arr).alias(name)).where(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, arr: Column, pos: str, name: str, *keep) -> DataFrame:
    """One row per element with its 0-based position."""
    return df.select(*keep, F.posexplode_outer(arr).alias(pos, name)).where(F.col(pos).isNotNull())


def row_slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive slices ``(start, stop)`` of a batch's rows: below ``limit`` in size, but for the first row's own."""
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)])
