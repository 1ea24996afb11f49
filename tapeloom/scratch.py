"""Folders for intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder, wherever Spark can reach it; false if there was none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def folders(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """The addresses below a folder that match, none if there is no such folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return [f.getPath().toString() for f in found or []]


def replace(spark: SparkSession, path: str, target: str) -> None:
    """Put one folder in another's place; doing it again after a break gives the same."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old, new = of(path), of(target)
    files = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(new, True)
    files.mkdirs(new.getParent())
    if not files.rename(old, new):
        raise OSError(f"{path} could not be moved to {target}")


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, under ``spark.checkpoint.dir`` (in local mode our own where that is unset); deleted when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tapeloom-")
    path = f"{root.rstrip('/')}/tapeloom-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            delete(spark, path)
        except Exception:  # the JVM is gone; whoever owns the folder clears it
            pass

    atexit.register(remove)
    return path
