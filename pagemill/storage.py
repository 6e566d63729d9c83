"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, removed when the driver ends. Where spark.checkpoint.dir is unset a local master
    takes a new folder on this machine; a cluster's executors would not see that, so there the setting is asked for."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root}/tables-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(remove, spark, folder)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of stored tables, if there is a session left to do it with."""
    if spark.sparkContext._jsc is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table that is written once and read again: its lineage ends here and it outlives any executor."""
    path = path or f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
