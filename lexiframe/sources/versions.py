"""Datasets that are replaced as a whole or not at all.

A dataset is a folder with data folders and numbered manifests; the manifest with the largest number names the data that
readers see.  A write puts its data into a new folder first, and one rename of a finished manifest makes it
visible: a write that fails on the way leaves the old data as it was, and readers that began before keep theirs.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("errorifexists", "ignore", "overwrite")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _child(spark: SparkSession, path: str, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the dataset's manifests, ascending; none if there is no dataset."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def _data_of(spark: SparkSession, path: str, version: int) -> str:
    file = spark.read.text(f"{path}/manifest-{version:010d}.json", wholetext=True).first()[0]
    return f"{path}/{json.loads(file)['data']}"


def save_version(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ("split",)) -> str:
    """Write a dataset: ``errorifexists`` fails if there is one, ``ignore`` leaves it, ``overwrite`` replaces it."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    spark = df.sparkSession
    old = versions(spark, path)
    if old and mode == "errorifexists":
        raise FileExistsError(path)
    if old and mode == "ignore":
        return path
    data = f"data-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{data}")
    number = old[-1] + 1 if old else 1
    draft, final = _child(spark, path, f".draft-{data}"), _child(spark, path, f"manifest-{number:010d}.json")
    _, fs = _fs(spark, path)
    out = fs.create(draft)
    out.write(bytearray(json.dumps({"data": data}).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise FileExistsError(f"{path}: another writer made version {number}")
    return path


def read_version(spark: SparkSession, path: str, split: str | None = None, version: int | None = None) -> DataFrame:
    """The dataset as its newest (or given) manifest names it."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{path}: no dataset" if not known else f"{path}: no version {version}")
    df = spark.read.parquet(_data_of(spark, path, known[-1] if version is None else version))
    return df if split is None else df.where(F.col("split") == split)


def drop_old_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` versions, and data that no manifest names (of failed writes); returns how many
    folders went.  For times without readers of old versions."""
    known = versions(spark, path)
    stay = {_data_of(spark, path, v).rsplit("/", 1)[1] for v in known[-keep:]}
    p, fs = _fs(spark, path)
    for v in known[:-keep]:
        fs.delete(_child(spark, path, f"manifest-{v:010d}.json"), False)
    gone = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith(("data-", ".draft-"))
            and f.getPath().getName() not in stay]
    for g in gone:
        fs.delete(g, True)
    return len([g for g in gone if g.getName().startswith("data-")])
