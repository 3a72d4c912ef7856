"""A new folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """In ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="annolake-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Gives a written folder its final name, which must be free: one rename, so readers see all of it or nothing."""
    at, to = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path))
    files = to.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(to):
        raise ValueError(f"{path} is there already")
    files.mkdirs(to.getParent())
    if not files.rename(at, to):
        raise OSError(f"{staged} could not be renamed {path}")


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that was written to be published."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def mounted(path: str) -> str:
    """The path by which a mounted folder is opened without Spark."""
    scheme, sep, rest = path.partition(":")
    if not sep or "/" in scheme:
        return path
    if scheme != "file":
        raise ValueError(f"{path} is in no mounted folder")
    return "/" + rest.lstrip("/")


def mounted_or_none(path: str) -> str | None:
    """As ``mounted``; none of a folder of another file system."""
    try:
        return mounted(path)
    except ValueError:
        return None
