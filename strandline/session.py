"""A Spark session with the settings that the expressions of this package assume."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "strandline", **settings: str) -> SparkSession:
    """The running session, or a new one; keyword names use underscores for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process has asked for and not cleared.
_paths: list[str] = []


def shared_path(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share; where that is unset, in a local session only, a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + os.path.join(tempfile.gettempdir(), "strandline-checkpoints")
    path = f"{top.rstrip('/')}/table-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def clear_shared(spark: SparkSession) -> None:
    """Deletes what was written under these paths."""
    conf = spark._jsc.hadoopConfiguration()
    while _paths:
        glob = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop() + "*")
        system = glob.getFileSystem(conf)
        for found in system.globStatus(glob) or []:
            system.delete(found.getPath(), True)
