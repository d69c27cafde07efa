"""Helpers shared by the pipeline operators.

Conventions of every operator in this package: it selects only the columns it
names (extra columns, whatever they are called, never clash), a null text is
treated as stated in its docstring, and rows with null or repeated ids are
rows like any other.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.session import checkpoint_dir, materialize, scratch_path, table_path

__all__ = ["checkpoint_dir", "materialize", "scratch_path", "table_path", "read", "lower_az",
           "lower_az_col", "WORDS", "fold", "pack_array", "unpack_array", "drop_scratch"]

#: Words of every operator here: runs of anything but ASCII white space.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOW = {ord(c): c.lower() for c in _UP}


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name)).select(*cols)


def lower_az(s: str) -> str:
    """Lower-case A-Z only."""
    return s.lower() if s.isascii() else s.translate(_LOW)


def lower_az_col(c: Column) -> Column:
    return F.translate(c, _UP, _UP.lower())


def fold(key: Column, modulus: int) -> Column:
    """Fold of a row: crc32 of the key as text, modulo ``modulus`` (null key: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def pack_array(a: np.ndarray) -> bytes:
    """A numpy array as compressed bytes, for a binary column."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack_array(b: bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a table that an operator wrote for itself, by Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [t if t is not None else "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]
