"""The folder that driver and executors share, for tables between the steps of an operator."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Where a laptop or a test without the setting keeps such tables.
LOCAL = "file:/tmp/checkpoints/scorelake"
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; it goes when the driver's JVM ends.

    Without the setting a folder of this machine serves a local master; a cluster's executors couldn't read it,
    so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else LOCAL
        if base == LOCAL and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = f"{base.rstrip('/')}/scorelake-{spark.sparkContext.applicationId}"
    if folder not in _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _made.add(folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """The path of a new table or folder."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
