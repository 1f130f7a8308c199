"""File listings: (project_id, path), paths relative to the project and '/'-separated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taskfold.functions.paths import relative_to
from taskfold.schema import FILE_LISTING


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """A stored manifest, such as an object-store inventory."""
    return spark.read.schema(FILE_LISTING).parquet(path)


def listing_of_folder(spark: SparkSession, project_id: str, root: str) -> DataFrame:
    """List a folder with Spark's own file source.

    A convenience: Spark leaves out names that start with '.' or '_' and empty files.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    plain = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    base = F.regexp_replace(F.lit(root), "^[a-z0-9]+:/+", "/")
    return found.select(F.lit(project_id).alias("project_id"), relative_to(plain, base).alias("path"))
