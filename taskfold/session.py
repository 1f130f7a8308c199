"""Session defaults and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(app_name: str = "taskfold") -> SparkSession.Builder:
    """A session builder with the defaults the library is tested with."""
    b = SparkSession.builder.appName(app_name)
    for key, value in DEFAULTS.items():
        b = b.config(key, value)
    return b


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    A session that names none gets a temporary one, but only where driver and executors are one process: elsewhere
    each machine would write to its own disk, and rows would be missing when the table is read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: computed once, with no lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/taskfold-{name}-{uuid.uuid4().hex}"
