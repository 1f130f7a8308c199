"""Upkeep of a registry: inverted index, facets, archiving, file mappings, limits, visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taskfold import fixed
from taskfold.operators.skew import HEAVY_ROWS, find_heavy_keys, number_rows
from taskfold.schema import KEY


def file_postings(features: DataFrame) -> DataFrame:
    """Inverted index, flat: one row per (project, file, item)."""
    return features.select("project_id", F.explode("files_involved").alias("file"), "id").distinct()


def file_index(
    features: DataFrame, ids_per_row: int = fixed.MAX_FEATURES, min_heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Inverted index with nested, sorted item lists; a long list goes on in further parts."""
    return nested_postings(file_postings(features), ids_per_row, min_heavy_rows)


def nested_postings(postings: DataFrame, ids_per_row: int = fixed.MAX_FEATURES, min_heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The same of flat postings (project_id, file, id)."""
    key, order = ["project_id", "file"], [F.col("id")]
    numbered = number_rows(postings, key, order, "_n", find_heavy_keys(postings, key, order, min_heavy_rows))
    return (
        numbered.withColumn("part", F.floor((F.col("_n") - 1) / ids_per_row).cast("long"))
        .groupBy("project_id", "file", "part")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )


def facets(features: DataFrame) -> DataFrame:
    """Item counts per status, domain and tag of each project, in one scan and one shuffle."""
    pairs = F.concat(
        F.array(
            F.struct(F.lit("status").alias("facet"), F.col("status").alias("value")),
            F.struct(F.lit("domain").alias("facet"), F.col("domain").alias("value")),
        ),
        F.transform(F.array_distinct("tags"), lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value"))),
    )
    return (
        features.select("project_id", F.explode(pairs).alias("p"))
        .groupBy("project_id", "p.facet", "p.value")
        .agg(F.count("*").alias("n_features"))
    )


def is_archivable(as_of: int, days: int = fixed.ARCHIVE_AFTER_DAYS):
    return F.col("last_updated") < F.lit(as_of - days * 86400).cast("long")


def split_archive(
    features: DataFrame, as_of: int, days: int = fixed.ARCHIVE_AFTER_DAYS
) -> tuple[DataFrame, DataFrame]:
    """(live, archived) items, by age of the last update. Both filters are pushed to the scan."""
    old = is_archivable(as_of, days)
    return features.filter(~old), features.filter(old)


def drop_stale_files(features: DataFrame, listing: DataFrame) -> DataFrame:
    """Take files that no longer exist out of ``files_involved``; order and repeats of the others stay.

    The items themselves are not shuffled by file: only (item, position, file) is.
    """
    mapped = features.select(*KEY, F.posexplode("files_involved").alias("pos", "path"))
    present = mapped.join(listing.select("project_id", "path").distinct(), ["project_id", "path"], "left_semi")
    kept = present.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pos", "path"))).alias("_kept"))
    files = F.coalesce(F.transform("_kept", lambda k: k["path"]), F.array().cast("array<string>"))
    return (
        features.join(kept, list(KEY), "left").withColumn("files_involved", files).select(*features.columns)
    )


def distinct_files(features: DataFrame) -> DataFrame:
    return features.withColumn("files_involved", F.array_distinct("files_involved"))


def shorten_descriptions(features: DataFrame, max_chars: int = fixed.MAX_DESCRIPTION_CHARS) -> DataFrame:
    return features.withColumn("description", F.substring("description", 1, max_chars))


def limit_audit(features: DataFrame) -> DataFrame:
    """Sizes of each project against the limits.

    Files are counted as distinct (project, file) pairs, so the count is combined before each shuffle.
    """
    zero = F.lit(0).cast("long")
    per_item = features.groupBy("project_id").agg(
        F.count("*").alias("n_features"), F.max(F.length("description")).cast("long").alias("max_description")
    )
    per_file = (
        features.select("project_id", F.explode("files_involved").alias("file"))
        .distinct()
        .groupBy("project_id")
        .agg(F.count("*").alias("n_files"), F.max(F.length("file")).cast("long").alias("max_path"))
    )
    sizes = per_item.join(per_file, "project_id", "left").select(
        "project_id",
        "n_features",
        F.coalesce("n_files", zero).alias("n_files"),
        F.coalesce("max_path", zero).alias("max_path"),
        "max_description",
    )
    return sizes.withColumn(
        "over_limit",
        (F.col("n_features") > fixed.MAX_FEATURES)
        | (F.col("n_files") > fixed.MAX_FILES)
        | (F.col("max_path") > fixed.MAX_PATH_CHARS)
        | (F.col("max_description") > fixed.MAX_DESCRIPTION_CHARS),
    )


def attention_map(visits: DataFrame) -> DataFrame:
    """Visits per (project, item, target)."""
    return visits.groupBy("project_id", "feature_id", "target").agg(F.count("*").alias("n_visits"))
