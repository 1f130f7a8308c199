"""Change documents in, JSON out."""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from taskfold import fixed
from taskfold.operators.skew import HEAVY_ROWS, find_heavy_keys, number_rows
from taskfold.schema import FEATURE_BODY, PATCH, PATCH_NAMES, REMOVE, STORED_ORDER, UPDATE_DOC, UPDATE_LOG, UPSERT
from taskfold.session import scratch_path, stored

_LISTS = ("tags", "files_involved")  # fields of a change that hold lists


def read_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Files of change documents, one a file, or one a line without ``multi_line``; an invalid one fails the job."""
    return parse_documents(spark.read.text(path, wholetext=multi_line), "value")


def parse_documents(texts: DataFrame, column: str = "json") -> DataFrame:
    """Parse a text column strictly: any structural error of :func:`document_errors` fails the job."""
    others = [c for c in texts.columns if c != column]
    # The filter looks at a row number as well: below the parse, where Spark would else move it, it would parse again.
    found = _parsed(texts, column).withColumn("_row", F.monotonically_increasing_id())
    failed = F.raise_error(F.concat(F.lit("invalid document: "), F.col("error")))
    kept = found.filter(F.when(F.col("error").isNull(), F.col("_row") >= 0).otherwise(failed.cast("boolean")))
    return with_empty_lists(kept.select(*others, "_doc.*"))


def checked_documents(texts: DataFrame, column: str = "json") -> DataFrame:
    """All columns, ``error`` and those of a document; an invalid text has its error and null or empty fields."""
    parsed = _parsed(texts, column)
    names = UPDATE_DOC.fieldNames()
    return with_empty_lists(
        parsed.select(*texts.columns, "error", *[F.when(F.col("error").isNull(), F.col("_doc")[n]).alias(n) for n in names])
    )


def document_errors(texts: DataFrame, column: str = "json") -> DataFrame:
    """Add ``error``: why a text is not a valid document, or null.

    A text is one JSON object, without a repeated key and with nothing after it. A missing list means an
    empty one, but an explicit ``null`` list is an error, as are a value of another type than its field's, a
    change without an id and a status spelled in any other way than the stored ones. Optional fields of a
    change may be null; entries of their lists may not.
    """
    doc = F.col("_doc")
    error = F.coalesce("error", change_error(doc["features"], doc["remove_features"]))
    return _parsed(texts, column).select(*[c for c in texts.columns if c != "error"], error.alias("error"))


def change_error(features: Column, removals: Column) -> Column:
    """What is wrong with the changes of a well-formed document; null if nothing is."""
    no_id = F.exists(features, lambda p: p.isNull() | p["id"].isNull())
    odd_status = F.exists(features, lambda p: p["status"].isNotNull() & ~p["status"].isin(*fixed.STATUSES))
    null_id = F.exists(removals, lambda r: r.isNull())
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(no_id) | yes(null_id), "change without id").when(yes(odd_status), "unknown status")


def _parsed(texts: DataFrame, column: str) -> DataFrame:
    """``texts`` with ``error`` (structural errors only) and ``_doc``, the typed document.

    A text that is just what its document is written as has no other structure than a document's. Only other texts are
    also parsed to a tree; steps are columns of their own, so that none is computed again. Spark's parsers stop at the end of
    the first value. So the text is put into an array before its own hash: only a text that is one value leaves an array of
    just these two.
    """
    raw = F.col(column)
    mark = F.xxhash64(raw)
    typed = texts.withColumn("_doc", F.from_json(raw, UPDATE_DOC))
    plain = typed.withColumn("_plain", F.coalesce(F.to_json("_doc") == raw, F.lit(False)))
    array = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(","), mark.cast("string"), F.lit("]")))
    whole = plain.withColumn("_all", F.when(~F.col("_plain"), array))
    at = lambda i, kind: F.try_variant_get("_all", f"$[{i}]", kind)
    one_value = F.coalesce((at(1, "long") == mark) & at(2, "variant").isNull(), F.lit(False))
    tree = whole.withColumn("_tree", F.when(one_value, at(0, "variant"))).drop("_all")
    shaped = tree.withColumns({
        "_shape": F.schema_of_variant("_tree"),
        "_doc": F.when(F.col("_plain") | F.col("_tree").isNotNull(), F.col("_doc")),
    })
    return shaped.withColumn("error", _structural_error(raw)).drop("_tree", "_shape", "_plain")


def _usual_shape() -> str:
    """A pattern for the shape of documents that hold nothing but known fields of the right types."""
    text, texts = "(STRING|VOID)", "(ARRAY<(STRING|VOID)>|VOID)"
    fields = "|".join(f"{n}: {texts if n in _LISTS else text}" for n in ("id", *PATCH_NAMES))
    change = f"OBJECT<(({fields})(, )?)*>"
    top = [f"features: ARRAY<({change}|VOID)>", "remove_features: ARRAY<(STRING|VOID)>", f"project_id: {text}", "batch_(seq|ts): (BIGINT|VOID)"]
    return f"^OBJECT<(({'|'.join(top)})(, )?)*>$"


def _structural_error(raw: Column) -> Column:
    """What is wrong with a text before its changes are looked at; null if nothing is.

    A text as it would be written, or a usual shape, needs no more than a look for nulls in lists, which shapes don't tell. Only in other ones is
    each field looked at.
    """
    tree, shape, doc = F.col("_tree"), F.col("_shape"), F.col("_doc")
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("ABSENT"))
    at = lambda v, field: F.try_variant_get(v, f"$.{field}", "variant")
    listed = lambda v: F.try_variant_get(v, "$", "array<variant>")
    is_null = lambda v: v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))

    def of(value: Column, *kinds: str) -> Column:
        return kind(value).isin("ABSENT", "VOID", *kinds)

    def strings(value: Column, null_allowed: bool) -> Column:
        entry = (lambda v: is_null(v) | (kind(v) == "STRING")) if null_allowed else (lambda v: kind(v) == "STRING")
        return of(value) | F.coalesce(F.forall(listed(value), entry), F.lit(False))

    def change(value: Column) -> Column:
        texts = of(at(value, "id"), "STRING")
        for field in PATCH_NAMES:
            texts = texts & (strings(at(value, field), False) if field in _LISTS else of(at(value, field), "STRING"))
        return is_null(value) | (kind(value).startswith("OBJECT") & texts)

    features, removals = at(tree, "features"), at(tree, "remove_features")
    typed = (
        of(at(tree, "project_id"), "STRING")
        & of(at(tree, "batch_seq"), "BIGINT")
        & of(at(tree, "batch_ts"), "BIGINT")
        & ((kind(features) == "ABSENT") | F.coalesce(F.forall(listed(features), change), F.lit(False)))
        & strings(removals, True)
    )
    holes = F.exists(
        doc["features"],
        lambda p: F.coalesce(F.exists(p["tags"], lambda t: t.isNull()), F.lit(False))
        | F.coalesce(F.exists(p["files_involved"], lambda t: t.isNull()), F.lit(False)),
    )
    usual = shape.rlike(_usual_shape())
    return (
        F.when(F.col("_plain"), F.when(F.coalesce(holes, F.lit(False)), "wrong type"))
        .when(raw.isNull() | (F.trim(raw) == ""), "blank input")
        .when(tree.isNull() | ~shape.startswith("OBJECT"), "malformed document")
        .when(usual, F.when(F.coalesce(holes, F.lit(False)), "wrong type"))
        .when((kind(features) == "VOID") | (kind(removals) == "VOID"), "null list")
        .when(~typed, "wrong type")
    )


def stamped(documents: DataFrame, project_id: str, batch_ts: int, first_seq: int) -> DataFrame:
    """Documents as users write them, which name no project, number or time, as arrivals of one project.

    ``documents`` has ``arrival``, a column to number them by from ``first_seq`` on; values must differ.
    Only these values are sorted, in ranges; a number is the place in a range after the rows of the ranges before.
    """
    spark = documents.sparkSession
    path = scratch_path(spark, "arrivals")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = documents.select("arrival").repartitionByRange(ranges, "arrival").sortWithinPartitions("arrival")
    dealt.select(F.col("arrival").alias("_at"), F.monotonically_increasing_id().alias("_place")).write.parquet(path)
    places = spark.read.parquet(path).selectExpr("_at", "shiftright(_place, 33) AS _range", "_place & ((1L << 33) - 1) AS _place")
    counts = {r["_range"]: r["n"] for r in places.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # one a range
    starts = list(accumulate((counts.get(i, 0) for i in range(max(counts, default=0) + 1)), initial=first_seq))
    seq = F.element_at(F.from_json(F.lit(json.dumps(starts)), "array<bigint>"), (F.col("_range") + 1).cast("int")) + F.col("_place")
    numbers = places.select("_at", seq.alias("batch_seq"))
    bare = documents.drop("project_id", "batch_seq", "batch_ts")
    numbered = bare.join(numbers, bare["arrival"].eqNullSafe(numbers["_at"]))
    stamps = numbered.withColumn("project_id", F.lit(project_id)).withColumn("batch_ts", F.lit(batch_ts).cast("long"))
    return stamps.select(*[F.col(f.name).cast(f.dataType) for f in UPDATE_DOC])


def repeated_numbers(documents: DataFrame) -> DataFrame:
    """(project_id, batch_seq, n_documents) of numbers that two documents of a project share: an error to replay."""
    return documents.groupBy("project_id", "batch_seq").agg(F.count("*").alias("n_documents")).filter("n_documents > 1")


def with_empty_lists(documents: DataFrame) -> DataFrame:
    """Absent lists become empty ones."""
    return documents.withColumns(
        {
            "features": F.coalesce("features", F.array().cast(UPDATE_DOC["features"].dataType)),
            "remove_features": F.coalesce("remove_features", F.array().cast("array<string>")),
        }
    )


def flatten_documents(documents: DataFrame) -> DataFrame:
    """One row per change: array order is application order, removals come after all upserts."""
    head = ["project_id", "batch_seq", "batch_ts"]
    changes = F.concat(
        F.transform(
            "features", lambda p, i: _change(UPSERT, i, p["id"], {n: p[n] for n in PATCH_NAMES})
        ),
        F.transform("remove_features", lambda r, i: _change(REMOVE, i, r, {})),
    )
    return (
        documents.select(*head, F.explode(changes).alias("c"))
        .select(*head, "c.*")
        .select(*UPDATE_LOG.fieldNames())
    )


def _change(rank: int, pos: Column, item: Column, patch: dict[str, Column]) -> Column:
    return F.struct(
        F.lit(rank).alias("op_rank"),
        pos.cast("long").alias("pos"),
        item.alias("id"),
        *[patch.get(n, F.lit(None)).cast(PATCH[n].dataType).alias(n) for n in PATCH_NAMES],
    )


def feature_json(features: DataFrame) -> DataFrame:
    """One JSON object per item, fields in declared order, null context kept."""
    return features.select(
        "project_id",
        *STORED_ORDER,
        F.to_json(F.struct(*FEATURE_BODY.fieldNames()), {"ignoreNullFields": "false"}).alias("json"),
    )


def state_documents(
    features: DataFrame,
    projects: DataFrame,
    features_per_document: int = fixed.MAX_FEATURES,
    min_heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """(project_id, part, json): whole projects as nested documents, items in stored order.

    A project within the size limit is one document, part 0. A bigger one continues in further parts,
    so that no document ever holds more than one part; together they hold every item, and each says its number
    in ``part`` and how many there are in ``parts``. Projects without items get a document with an empty list.

    Only items of projects with several parts are numbered, by their keys alone. Items go to their documents in one
    exchange by project and part, and headers, one for each part, are joined where the documents lie. So the parts
    of a big project are spread over all tasks, whatever is broadcast.
    """
    order, place = [F.col(c) for c in STORED_ORDER], ["project_id", *STORED_ORDER, "id"]
    sizes = stored(features.groupBy("project_id").agg(F.count("*").alias("n")), "sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    placed = features.withColumn("part", F.lit(0).cast("long"))
    if most > features_per_document:
        large = sizes.filter(F.col("n") > features_per_document).select("project_id")
        slim = features.select(*place).join(large, "project_id", "left_semi")
        heavy = find_heavy_keys(slim, ["project_id"], order, min_heavy_rows) if most > min_heavy_rows else None
        numbered = number_rows(slim, ["project_id"], order, "_n", heavy)
        parts = numbered.select(*place, F.floor((F.col("_n") - 1) / features_per_document).cast("long").alias("part"))
        placed = placed.join(large, "project_id", "left_anti").unionByName(features.join(parts, place))
    nested = (
        placed.groupBy("project_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct(*STORED_ORDER, F.struct(*FEATURE_BODY.fieldNames()).alias("f")))).alias("_items"))
        .select("project_id", "part", F.transform("_items", lambda x: x["f"]).alias("features"))
    )
    nothing = F.array().cast(nested.schema["features"].dataType)
    many = F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(0)) / features_per_document)).cast("long")
    headers = projects.join(sizes, "project_id", "left").withColumn("parts", many)
    headers = headers.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    filled = headers.join(nested, ["project_id", "part"], "left").withColumn("features", F.coalesce("features", nothing))
    fields = ["project_name", "features", "created_at", "last_updated"]
    nulls = {"ignoreNullFields": "false"}
    whole, piece = F.to_json(F.struct(*fields), nulls), F.to_json(F.struct(*fields, "part", "parts"), nulls)
    return filled.select("project_id", "part", F.when(F.col("parts") > 1, piece).otherwise(whole).alias("json"))


def write_json_rows(features: DataFrame, path: str) -> None:
    """Items as JSON lines, nulls kept."""
    features.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
