"""Registry snapshots: one Parquet directory per version, written whole and never changed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from taskfold import fixed
from taskfold.operators.changelog import duplicate_keys
from taskfold.schema import FEATURE, KEY, PROJECT

_STORED = T.StructType([*FEATURE.fields, T.StructField("domain_lc", T.StringType())])


def save_snapshot(features: DataFrame, root: str, version: int, cluster: bool = True) -> str:
    """Write version ``version`` below ``root``; writing it again replaces it.

    Rows are dealt by ranges of (project_id, id) and sorted inside files, so a project lies in few files (a big one
    still spans many) and statistics let a reader of one project or item skip the rest. ``cluster=False``
    saves that shuffle. ``domain_lc`` makes the case-insensitive domain filter a plain equality the scan can
    push down. The keys of what was written are counted once, and a version without repeated ones is marked so; one with
    an item twice is removed again, and an error.
    """
    out = features.select(*FEATURE.fieldNames()).withColumn("domain_lc", F.lower("domain"))
    if cluster:
        out = out.repartitionByRange(*KEY)
    path = f"{root}/v={version}"
    out.sortWithinPartitions(*KEY).write.mode("overwrite").parquet(path)
    spark = features.sparkSession
    try:
        reject_duplicates(spark.read.schema(_STORED).parquet(path).select(*KEY))
    except ValueError:
        _files(spark, path)[0].delete(_files(spark, path)[1], True)
        raise
    fs, mark = _files(spark, f"{path}/{_UNIQUE}")
    fs.create(mark, True).close()
    return path


#: Marks a version in which no item is stored twice; readers of the folder pass over such names.
_UNIQUE = "_UNIQUE"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def load_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Read a version (default: the newest complete one). A missing registry is an error, as is an item stored twice;
    that is counted only where the version wasn't marked when it was saved."""
    if version is None:
        version = latest_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"registry not initialized: {root}")
    rows = spark.read.schema(_STORED).parquet(f"{root}/v={version}")
    fs, mark = _files(spark, f"{root}/v={version}/{_UNIQUE}")
    return rows if fs.exists(mark) else reject_duplicates(rows)


def committed(spark: SparkSession, root: str, name: str = "v") -> list[int]:
    """Numbers of the ``name=N`` directories below ``root`` whose write was committed, ascending."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    return sorted(
        int(m.group(1))
        for status in fs.listStatus(folder)
        if (m := re.fullmatch(rf"{name}=(-?\d+)", status.getPath().getName()))
        and fs.exists(hadoop.Path(status.getPath(), "_SUCCESS"))
    )


def latest_version(spark: SparkSession, root: str) -> int | None:
    return max(committed(spark, root), default=None)


def create_registry(spark: SparkSession, root: str) -> bool:
    """Write an empty registry as version 0, unless there is one. Tells whether it did."""
    if latest_version(spark, root) is not None:
        return False
    save_snapshot(spark.createDataFrame([], FEATURE), root, 0)
    return True


def add_projects(projects: DataFrame, project_ids: DataFrame, now: int) -> DataFrame:
    """Add projects not there yet; existing ones stay untouched."""
    stamp = F.lit(now).cast("long")
    new = (
        project_ids.select("project_id")
        .distinct()
        .join(projects.select("project_id"), "project_id", "left_anti")
        .select(
            "project_id",
            F.lit(fixed.DEFAULT_PROJECT_NAME).alias("project_name"),
            stamp.alias("created_at"),
            stamp.alias("last_updated"),
        )
    )
    return projects.select(*PROJECT.fieldNames()).unionByName(new)


def reject_duplicates(features: DataFrame) -> DataFrame:
    """The same rows, after a check that no item is stored twice."""
    twice = duplicate_keys(features).first()
    if twice is not None:
        raise ValueError(f"item {twice['id']!r} of project {twice['project_id']!r} is stored {twice['n_rows']} times")
    return features
