"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once a context: their workers need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_pagelight", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="pagelight-code-"), "pagelight.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(root)))
    context.addPyFile(path)
    context._pagelight = True


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where driver and executors are one process, a temporary folder if it isn't set."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_pagelight_shared", None)
    if not found:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = context._pagelight_shared = tempfile.mkdtemp(prefix="pagelight-")
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, for the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p, store = hadoop_path(spark, path)
    store.deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet into the shared folder and read back: it is computed once, and lost executors lose nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
