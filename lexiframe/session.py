"""Spark session helpers: local sessions for tests/bench, checkpoint folder lookup."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "lexiframe", driver_memory: str = "8g") -> SparkSession:
    """A local session configured like the cluster one (AQE on, Arrow on, UTC, no UI)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be configured (it has to be visible to every
    executor).  Only a local-mode session without a setting gets a fresh
    scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            conf_dir = None
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="lexiframe-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


#: Folders that this process wrote below checkpoint folders, by application.
_WRITTEN: dict[str, set[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the checkpoint folder (for written tables)."""
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table by Hadoop's file system, wherever it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN.get(spark.sparkContext.applicationId, set()).discard(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete the tables that this application wrote for itself, when no result that reads them is needed any more;
    returns how many."""
    paths = sorted(_WRITTEN.get(spark.sparkContext.applicationId, ()))
    for path in paths:
        drop_path(spark, path)
    return len(paths)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def materialize(df, name: str):
    """Write ``df`` once as parquet under the checkpoint folder and read it back:
    cuts the lineage (survives executor loss) with a single computation, unlike
    an eager ``checkpoint()`` which computes the plan twice."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out._scratch_path = path
    return out


def release(df) -> None:
    """Delete what ``materialize`` wrote for ``df``, once a later table has replaced it."""
    path = getattr(df, "_scratch_path", None)
    if path:
        drop_path(df.sparkSession, path)
