"""Counts and postings of a registry, kept up to date by its changes instead of being made anew.

A view is a count of rows by key. What a change does to it is the count of the touched items after the change less
that before it, so the items that weren't touched are not read. A stored view is a base and the changes since;
reading adds them up, and from time to time they are folded into a new base, also while others read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from taskfold import fixed
from taskfold.operators import housekeeping
from taskfold.sources.snapshots import committed

#: The views: how many rows each key has among some items.
FACETS, POSTINGS = "facets", "postings"


def facet_counts(items: DataFrame) -> DataFrame:
    """(project_id, facet, value, n): items by status, domain and tag."""
    return housekeeping.facets(items).withColumnRenamed("n_features", "n")


def posting_counts(items: DataFrame) -> DataFrame:
    """(project_id, file, id, n): which items name a file; ``n`` is 1."""
    return housekeeping.file_postings(items).withColumn("n", F.lit(1).cast("long"))


COUNTS: dict[str, Callable[[DataFrame], DataFrame]] = {FACETS: facet_counts, POSTINGS: posting_counts}


def difference(view: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """What becomes of the view when the items ``before`` turn into ``after``: keys and a signed ``n`` that isn't 0.

    Both are the touched items alone, or more; items in both that are alike cancel out.
    """
    count = COUNTS[view]
    both = count(after).unionByName(count(before).withColumn("n", -F.col("n")))
    return summed(both).filter("n <> 0")


def summed(rows: DataFrame) -> DataFrame:
    keys = [c for c in rows.columns if c != "n"]
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"))


def create(view: str, items: DataFrame, root: str, version: int) -> None:
    """Write the view of all items as the base of ``version``."""
    _write(COUNTS[view](items), f"{root}/base", version)


def apply(view: str, before: DataFrame, after: DataFrame, root: str, version: int) -> None:
    """Write what the change to ``version`` does to the view; writing it again replaces it."""
    _write(difference(view, before, after), f"{root}/change", version)


def _write(rows: DataFrame, folder: str, version: int) -> None:
    keys = [c for c in rows.columns if c != "n"]
    rows.sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{folder}/v={version}")


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The view as of ``version`` (default: the newest): the newest base up to it and the changes after that."""
    bases, changes = committed(spark, f"{root}/base"), committed(spark, f"{root}/change")
    if version is None:
        version = max([*bases, *changes], default=-1)
    base = max((v for v in bases if v <= version), default=None)
    if base is None:
        raise FileNotFoundError(f"no view at {root}")
    rows = spark.read.parquet(f"{root}/base/v={base}")
    since = [f"{root}/change/v={v}" for v in changes if base < v <= version]
    if since:
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*since))
    return summed(rows).filter("n > 0")


def fold(spark: SparkSession, root: str) -> int:
    """Write a base of the newest version, and return that. Older files stay for those who read them."""
    newest = max([*committed(spark, f"{root}/base"), *committed(spark, f"{root}/change")])
    if newest not in committed(spark, f"{root}/base"):
        _write(read(spark, root, newest), f"{root}/base", newest)
    return newest


def feature_counts(facets: DataFrame) -> DataFrame:
    """Items per project, of a view of facets: each item has one status."""
    of = facets.filter("facet = 'status'")
    return of.groupBy("project_id").agg(F.sum("n").alias("n_features"))


def completion_summary(facets: DataFrame) -> DataFrame:
    """Complete and total items per project, of a view of facets."""
    done = F.coalesce(F.sum(F.when(F.col("value") == fixed.DONE_STATUS, F.col("n"))), F.lit(0).cast("long"))
    per = facets.filter("facet = 'status'").groupBy("project_id").agg(done.alias("n_complete"), F.sum("n").alias("n_total"))
    return per.withColumn("label", F.concat_ws("/", "n_complete", "n_total"))


def file_index(postings: DataFrame, ids_per_row: int = fixed.MAX_FEATURES) -> DataFrame:
    """The inverted index with sorted lists, of a view of postings; see :func:`housekeeping.file_index`."""
    return housekeeping.nested_postings(postings.select("project_id", "file", "id"), ids_per_row)
