"""File-inventory profile: extension histogram, top directories, suggested items, nested report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from taskfold import fixed
from taskfold.functions.paths import (
    below_source_root,
    extension,
    in_visible_top_directory,
    second_component,
    top_component,
    under_skipped_directory,
)
from taskfold.functions.text import infer_domain, title_case
from taskfold.operators.skew import HEAVY_ROWS, find_heavy_keys, number_rows
from taskfold.session import stored

PROJECT = "project_id"
GROUP = (PROJECT, "source_root", "suggested_id")


def counted_files(listing: DataFrame) -> DataFrame:
    """Files not below a skipped directory. Everything but the directory list works on these."""
    return listing.filter(~under_skipped_directory(F.col("path")))


def extension_histogram(listing: DataFrame) -> DataFrame:
    """Files per lower-cased extension; files without one are not counted."""
    return (
        counted_files(listing)
        .select(PROJECT, extension(F.col("path")).alias("ext"))
        .filter(F.col("ext").isNotNull())
        .groupBy(PROJECT, "ext")
        .agg(F.count("*").alias("n_files"))
    )


def total_files(listing: DataFrame) -> DataFrame:
    """Counted files per project; a project whose files are all skipped counts zero."""
    kept = ~under_skipped_directory(F.col("path"))
    return listing.groupBy(PROJECT).agg(F.count_if(kept).alias("total_files"))


def top_directories(listing: DataFrame) -> DataFrame:
    """Visible first-level directories, also those whose files are all skipped."""
    path = F.col("path")
    return listing.filter(in_visible_top_directory(path)).select(PROJECT, top_component(path).alias("directory")).distinct()


def source_files(listing: DataFrame) -> DataFrame:
    """Files below a visible first-level sub-directory of a source root, with that sub-directory's name."""
    path = F.col("path")
    return (
        counted_files(listing)
        .filter(below_source_root(path))
        .select(PROJECT, top_component(path).alias("source_root"), second_component(path).alias("suggested_id"), "path")
    )


def root_position(root: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in fixed.SOURCE_ROOTS]), root)


def suggested_features(listing: DataFrame) -> DataFrame:
    """Sub-directories with enough files, named and classified. Their files: :func:`suggestion_files`."""
    return (
        source_files(listing)
        .groupBy(*GROUP)
        .agg(F.count("*").alias("n_files"))
        .filter(F.col("n_files") >= fixed.MIN_SUGGESTION_FILES)
        .select(
            *GROUP,
            title_case(F.col("suggested_id")).alias("suggested_name"),
            infer_domain(F.col("suggested_id")).alias("suggested_domain"),
            "n_files",
        )
    )


def suggestion_files(listing: DataFrame) -> DataFrame:
    """The files of all suggested items, one row per file."""
    files = source_files(listing)
    groups = files.groupBy(*GROUP).agg(F.count("*").alias("n"), F.min(_spread(F.col("path"))).alias("hash"))
    return _without_small(files, groups)


def _spread(path: Column) -> Column:
    return F.xxhash64(path)


def _without_small(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Files of sub-directories that are not too small.

    A too small one has a single file, so joining on that file's hash as well drops nothing else, and
    spreads the files of a huge sub-directory over all tasks.
    """
    small = groups.filter(F.col("n") < fixed.MIN_SUGGESTION_FILES).select(*GROUP, "hash")
    return (
        files.withColumn("hash", _spread(F.col("path"))).join(small, [*GROUP, "hash"], "left_anti").select(*GROUP, "path")
    )


def count_suggestions(listing: DataFrame) -> DataFrame:
    return suggested_features(listing).groupBy(PROJECT).agg(F.count("*").alias("n_suggestions"))


def in_suggestion_order(suggestions: DataFrame) -> DataFrame:
    return suggestions.orderBy(PROJECT, "suggested_id", root_position(F.col("source_root")))


def top_extensions(histogram: DataFrame, k: int = fixed.SUMMARY_EXTENSIONS) -> DataFrame:
    """The k most frequent extensions per project; ties go to the smaller name."""
    best = Window.partitionBy(PROJECT).orderBy(F.col("n_files").desc(), "ext")
    return histogram.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)


def extension_summary(listing: DataFrame) -> DataFrame:
    """``rs (12), py (3)`` per project, or a fixed text when there are no extensions."""
    top = (
        top_extensions(extension_histogram(listing))
        .groupBy(PROJECT)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "ext", "n_files"))).alias("top"))  # at most k entries
    )
    words = F.transform("top", lambda t: F.concat(t["ext"], F.lit(" ("), t["n_files"].cast("string"), F.lit(")")))
    return (
        listing.select(PROJECT)
        .distinct()
        .join(top, PROJECT, "left")
        .select(PROJECT, F.coalesce(F.array_join(words, ", "), F.lit(fixed.NO_EXTENSIONS_TEXT)).alias("summary"))
    )


def profile_counts(listing: DataFrame) -> DataFrame:
    """All counts of the profile in one scan and one shuffle.

    Rows (project_id, kind, name, root, n): ``listed`` and ``total`` (counted) files, ``ext`` per extension, ``dir`` per
    visible top directory (all its files), ``sub`` per sub-directory of a source root, with its root.
    """
    return _counts(listing).drop("hash")


def _counts(listing: DataFrame) -> DataFrame:
    """The counts, and for a sub-directory the smallest hash of its paths."""
    path = F.col("path")
    looked_at = listing.select(PROJECT, "path", (~under_skipped_directory(path)).alias("kept")).select(
        PROJECT,
        "kept",
        F.when(F.col("kept"), extension(path)).alias("ext"),
        F.when(in_visible_top_directory(path), top_component(path)).alias("dir"),
        F.when(F.col("kept") & below_source_root(path), top_component(path)).alias("root"),
        F.when(F.col("kept") & below_source_root(path), second_component(path)).alias("sub"),
        _spread(path).alias("hash"),
    )
    # Few combinations stand for many paths, so they are counted before being taken apart.
    combined = looked_at.groupBy(PROJECT, "kept", "ext", "dir", "root", "sub").agg(
        F.count("*").alias("n"), F.min("hash").alias("hash")
    )

    def fact(kind: str, name: Column, root: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), name.alias("name"), root.alias("root")))

    nothing = F.lit(None).cast("string")
    facts = F.array(
        fact("listed", nothing, nothing, F.lit(True)),
        fact("total", nothing, nothing, F.col("kept")),
        fact("ext", F.col("ext"), nothing, F.col("ext").isNotNull()),
        fact("dir", F.col("dir"), nothing, F.col("dir").isNotNull()),
        fact("sub", F.col("sub"), F.col("root"), F.col("sub").isNotNull()),
    )
    return (
        combined.select(PROJECT, "n", "hash", F.explode(F.array_compact(facts)).alias("f"))
        .groupBy(PROJECT, "f.kind", "f.name", "f.root")
        .agg(F.sum("n").alias("n"), F.min("hash").alias("hash"))
    )


def report_documents(
    listing: DataFrame, entries_per_document: int = fixed.MAX_FILES, min_heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """(project_id, part, json): the discovery report of each project as nested JSON.

    A project with up to ``entries_per_document`` entries (suggestion files, extensions, directories) is
    one document, part 0. The entries of a bigger one are spread over several parts of about that size
    by hash, so no task nests more than a part; a sub-directory stays whole unless it is bigger than a
    part itself, and is then cut in the order of its paths. ``root`` and ``total_files`` are in every part, and where
    there is more than one, so are ``part`` and ``parts``: its number and how many there are. A suggested item of such
    a project says where it stands in the whole report: ``place`` among the suggested items, ``first`` of its files.
    """
    # Used several times below; written once, it leaves two scans of the listing: for counts and for files.
    counts = stored(_counts(listing), "profile")
    is_sub = F.col("kind") == "sub"
    entry_count = (
        F.when(F.col("kind").isin("ext", "dir"), 1)
        .when(is_sub & (F.col("n") >= fixed.MIN_SUGGESTION_FILES), F.col("n"))
        .otherwise(0)
    )
    headers = counts.groupBy(PROJECT).agg(
        F.greatest(F.lit(1), F.ceil(F.sum(entry_count) / entries_per_document)).cast("int").alias("_parts"),
        F.coalesce(F.max(F.when(F.col("kind") == "total", F.col("n"))), F.lit(0).cast("long")).alias("total_files"),
    )

    def part(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.col("_parts")).cast("long").alias("part")

    subs = counts.filter(is_sub).withColumnsRenamed({"root": "source_root", "name": "suggested_id"})
    # Files: placed by sub-directory, an oversized one in slices that follow each other. All that a file needs to know comes
    # with its sub-directory; they are then dealt by slice, so that neither a big project nor a big directory is one task.
    big = subs.filter(F.col("n") >= fixed.MIN_SUGGESTION_FILES)
    order = [F.col("suggested_id"), root_position(F.col("source_root"))]
    numbered = number_rows(big, [PROJECT], order, "_place", find_heavy_keys(big, [PROJECT], order, min_heavy_rows))
    wanted = numbered.join(headers.select(PROJECT, "_parts"), PROJECT).select(*GROUP, "_parts", (F.col("_place") - 1).alias("_place"))
    most = big.agg(F.max("n")).first()[0] or 0
    files = source_files(listing).join(wanted, list(GROUP))
    heavy = find_heavy_keys(files, GROUP, [F.col("path")], min_heavy_rows) if most > min_heavy_rows else None
    numbered = number_rows(files, GROUP, [F.col("path")], "_n", heavy)
    files = numbered.withColumn("_slice", F.floor((F.col("_n") - 1) / entries_per_document).cast("long"))
    many = F.col("_parts") > 1
    suggestions = (
        files.select(*GROUP, "_slice", part(F.col("source_root"), F.col("suggested_id"), F.col("_slice")), "path", "_place", "_parts")
        .repartition(*GROUP, "_slice")
        .groupBy(*GROUP, "_slice", "part", "_place", "_parts")
        .agg(F.sort_array(F.collect_list("path")).alias("files"))
        .select(
            PROJECT,
            "part",
            F.struct(
                "suggested_id",
                root_position(F.col("source_root")).alias("root"),
                F.struct(
                    "suggested_id",
                    title_case(F.col("suggested_id")).alias("suggested_name"),
                    infer_domain(F.col("suggested_id")).alias("suggested_domain"),
                    "files",
                    F.when(many, F.col("_place")).alias("place"),
                    F.when(many, F.col("_slice") * entries_per_document).alias("first"),
                ).alias("body"),
            ).alias("_sugg"),
        )
    )
    others = (
        counts.filter(F.col("kind").isin("ext", "dir"))
        .join(headers.select(PROJECT, "_parts"), PROJECT)
        .select(
            PROJECT,
            part(F.col("kind"), F.col("name")),
            F.when(F.col("kind") == "ext", F.struct("name", "n")).alias("_ext"),
            F.when(F.col("kind") == "dir", F.col("name")).alias("_dir"),
        )
    )
    # Every part is there, also one that got no entries.
    every = F.sequence(F.lit(0).cast("long"), F.col("_parts") - F.lit(1).cast("long"))
    frame = headers.select(PROJECT, F.explode(every).alias("part"), "total_files", "_parts")
    entries = suggestions.unionByName(others, allowMissingColumns=True).unionByName(frame, allowMissingColumns=True)
    report = F.struct(
        F.col(PROJECT).alias("root"),
        F.map_from_entries(F.sort_array("_ext")).alias("languages"),
        F.sort_array("_dir").alias("directories"),
        F.transform(F.sort_array("_sugg"), lambda s: s["body"]).alias("potential_features"),
        "total_files",
        F.when(F.col("_parts") > 1, F.col("part")).alias("part"),
        F.when(F.col("_parts") > 1, F.col("_parts")).alias("parts"),
    )
    return (
        entries.groupBy(PROJECT, "part")
        .agg(
            F.collect_list("_ext").alias("_ext"),
            F.collect_list("_dir").alias("_dir"),
            F.collect_list("_sugg").alias("_sugg"),
            F.max("total_files").alias("total_files"),
            F.max("_parts").alias("_parts"),
        )
        .select(PROJECT, "part", F.to_json(report).alias("json"))
    )
