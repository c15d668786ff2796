"""Cutting the lineage of iterative plans with tables on shared storage.

Executors may be lost at any time, so nothing is kept only on executor disks: a cut writes a
Parquet table below ``spark.checkpoint.dir`` and reads it back.  A side effect worth having is
that the new scan has exact size statistics, so later joins pick their strategy from facts.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []
_WRITTEN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's checkpoint folder.

    Only a local session without one gets a folder of its own; a cluster must name it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if not _LOCAL_ROOT:
        path = tempfile.mkdtemp(prefix="spark-riskgraph-")
        _LOCAL_ROOT.append(path)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return _LOCAL_ROOT[0]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def cut_all(frames: dict[str, DataFrame], threads: int = 4) -> dict[str, DataFrame]:
    """Cut several independent frames; their jobs run side by side and share the cluster."""
    with ThreadPoolExecutor(threads) as pool:
        jobs = {n: pool.submit(inheritable_thread_target(f.sparkSession)(cut), f, n) for n, f in frames.items()}
        return {n: j.result() for n, j in jobs.items()}


def release(df: DataFrame | None) -> None:
    """Delete the table behind a frame made by :func:`cut`, once nothing reads it any more."""
    path = getattr(df, "_cut_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete every table this process has cut; call it when no result is read any more."""
    for path in list(_WRITTEN):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)
