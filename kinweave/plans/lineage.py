"""Lineage cuts that survive the loss of an executor, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_PATHS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where that is unset, a temporary folder serves a local master (tests); on a cluster it is an error, since every
    executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="kinweave-")
        atexit.register(shutil.rmtree, _OWN_DIR[app], True)
    return "file://" + os.path.abspath(_OWN_DIR[app])


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    _PATHS.append(f"{shared_dir(spark)}/kinweave/{name}-{uuid.uuid4().hex[:12]}")
    return _PATHS[-1]


def sweep(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process, once the results built on them are stored elsewhere."""
    while _PATHS:
        remove(spark, _PATHS.pop())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder once and return the written table: later stages read files, not lineage."""
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._kinweave_path = path
    return back


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that materialise returned; nothing may read it afterwards."""
    path = getattr(df, "_kinweave_path", None)
    if path:
        remove(df.sparkSession, path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when a count proves that df has at most max_rows rows; else leave the join to a shuffle."""
    return F.broadcast(df) if len(df.select(F.lit(1)).take(max_rows + 1)) <= max_rows else df
