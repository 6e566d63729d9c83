"""Session defaults and the one place that knows how tables are laid out in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with the defaults above; on a cluster, pass the master of the cluster and its own settings."""
    builder = SparkSession.builder.master(master).appName("pagemill")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Inputs below this size are dealt out over all cores before texts are taken apart.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input, which as one file with one row group is one task, over all cores; a larger one, which has splits enough, as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` of a folder; only Spark's reader touches the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
