"""Ranked report, counts and completion summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from taskfold import fixed
from taskfold.functions.recency import percent_label, recency_score
from taskfold.functions.text import truncate
from taskfold.operators.skew import HEAVY_ROWS, find_heavy_keys, number_rows
from taskfold.schema import STORED_ORDER


def rank_order() -> list[Column]:
    """Best score first; equal scores keep the stored order. Written ascending, so rows can be cut in ranges."""
    return [-F.col("recency_score"), *[F.col(c) for c in STORED_ORDER]]


def rescored(features: DataFrame, as_of: Column | int) -> DataFrame:
    """Replace the stored scores by those seen at ``as_of``."""
    return features.withColumn("recency_score", recency_score(F.col("last_updated"), as_of))


def ranked(features: DataFrame, min_heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Add ``rank`` (1 = most recent) within each project."""
    heavy = find_heavy_keys(features, ["project_id"], rank_order(), min_heavy_rows)
    return number_rows(features, ["project_id"], rank_order(), "rank", heavy)


def sorted_by_recency(features: DataFrame) -> DataFrame:
    """All items, project by project, best score first. A range sort: a big project spans many tasks."""
    return features.orderBy("project_id", F.col("recency_score").desc(), *STORED_ORDER)


def top_by_recency(features: DataFrame, k: int = fixed.TOP_BY_RECENCY) -> DataFrame:
    """The k best items of the whole registry."""
    return features.orderBy(F.col("recency_score").desc(), "project_id", *STORED_ORDER).limit(k)


def top_by_recency_per_project(features: DataFrame, k: int = fixed.TOP_BY_RECENCY) -> DataFrame:
    """The k best items of each project. Every task keeps only its own k best before the shuffle."""
    best = Window.partitionBy("project_id").orderBy(F.col("recency_score").desc(), *STORED_ORDER)
    return features.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)


def report_rows(features: DataFrame) -> DataFrame:
    """The columns a reader sees, cut to the report's widths."""
    kept = [c for c in ("project_id", "rank") if c in features.columns]
    return features.select(
        *kept,
        truncate(F.col("id"), fixed.REPORT_ID_WIDTH).alias("id"),
        truncate(F.col("domain"), fixed.REPORT_DOMAIN_WIDTH).alias("domain"),
        "status",
        percent_label(F.col("recency_score")).alias("recency"),
        "name",
    )


def is_complete() -> Column:
    return F.col("status") == fixed.DONE_STATUS


def completion_summary(features: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Complete and total items per project; with ``projects``, empty projects count zero."""
    per = features.groupBy("project_id").agg(
        F.count_if(is_complete()).alias("n_complete"), F.count("*").alias("n_total")
    )
    if projects is not None:
        zero = F.lit(0).cast("long")
        per = (
            projects.select("project_id")
            .join(per, "project_id", "left")
            .select(
                "project_id",
                F.coalesce("n_complete", zero).alias("n_complete"),
                F.coalesce("n_total", zero).alias("n_total"),
            )
        )
    return per.withColumn("label", F.concat_ws("/", "n_complete", "n_total"))


def feature_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("project_id").agg(F.count("*").alias("n_features"))
