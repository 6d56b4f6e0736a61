"""Session defaults used by tests and the bench; on a cluster the session comes from outside."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "nearlabel", **conf: str) -> SparkSession:
    """A local session with UTC time and AQE; keyword names use ``__`` for dots."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("NEARLABEL_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir`` as the cluster names it. Where it is unset, a local
    session, as in tests, gets a temporary folder as its checkpoint folder; a cluster has no folder that all its machines
    share, so there it must be named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="nearlabel-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scratch folders that this driver made and nobody has removed yet.
_LEFT: set[str] = set()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared one. It is kept in mind until it is removed."""
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _LEFT.add(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _LEFT.discard(path)


def release(spark: SparkSession) -> None:
    """Remove every scratch folder that is left. Results that are frames read theirs when they are used, so call this once
    they have been written or collected; a driver that ends does it by itself."""
    for path in list(_LEFT):
        remove(spark, path)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession() if _LEFT else None
    if spark is not None and spark.sparkContext._jsc is not None:
        release(spark)
