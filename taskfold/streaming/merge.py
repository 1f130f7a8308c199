"""Change documents as a stream, merged into the registry micro-batch by micro-batch.

The registry lies in key buckets (:mod:`taskfold.sources.buckets`); a micro-batch rewrites the buckets of the items
it names and no others. All that a micro-batch writes is named by its number, and the manifest comes last, so
one that is repeated after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from taskfold import fixed
from taskfold.operators.changelog import bad_status_documents, first_bad_documents, project_clock, replay
from taskfold.operators.lenient import replay_lenient
from taskfold.schema import UPDATE_DOC
from taskfold.sources import buckets
from taskfold.sources.documents import change_error, checked_documents, flatten_documents


class InvalidDocument(ValueError):
    """A document creates an item without a required field, or cannot be read."""


def document_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Files with a change document on each line, as they arrive: its text, ``error`` and the document's columns.

    Lines are read as text and parsed strictly, so one that is no document reaches the sink with its error
    instead of stopping the stream in the reader.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return checked_documents(lines.withColumnRenamed("value", "json"))


def merge_stream(
    documents: DataFrame,
    root: str,
    checkpoint: str,
    compact_every: int = 16,
    lenient: bool = False,
    bucket_rows: int = buckets.BUCKET_ROWS,
) -> StreamingQuery:
    """Start merging what has arrived into the registry at ``root`` (created when missing).

    Version N holds the first N micro-batches. With ``lenient`` invalid documents are skipped, and those with an
    error of :func:`document_errors` are kept in the folder ``rejected`` of the micro-batch; otherwise the first one
    stops the stream before its micro-batch is stored. The clocks of the projects are folded every ``compact_every``
    micro-batches.
    """
    folder = f"{root}/registry"
    buckets.create(documents.sparkSession, folder)

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        arrived = f"{root}/arrived/epoch={epoch}"
        batch.write.mode("overwrite").parquet(arrived)  # parsed once, for all that follows
        batch = spark.read.schema(batch.schema).parquet(arrived)
        unread = batch.filter("error IS NOT NULL").select("json", "error")
        read = batch.filter("error IS NULL").withColumn("error", change_error(F.col("features"), F.col("remove_features")))
        faulty = read.filter("error IS NOT NULL")
        batch = batch.filter("error IS NULL").select(*UPDATE_DOC.fieldNames())
        log = flatten_documents(batch)
        named = log.filter("id IS NOT NULL")
        own = buckets.touched(spark, folder, epoch, named)
        if lenient:
            unread.union(faulty.select("json", "error")).write.mode("overwrite").parquet(f"{root}/rejected/epoch={epoch}")
        else:
            first = unread.first()
            if first is not None:
                raise InvalidDocument(f"{first['error']}: {first['json'][:200]}")
            odd = bad_status_documents(log).first()
            if odd is not None:
                raise InvalidDocument(f"unknown status or missing id (project {odd[0]}, document {odd[1]})")
            bad = first_bad_documents(log, buckets.contents(spark, folder, own)).first()
            if bad is not None:
                reason = fixed.MISSING_FIELD_TEXT % (bad["id"], bad["field"])
                raise InvalidDocument(f"{reason} (project {bad['project_id']}, document {bad['batch_seq']})")
        clock, fold = project_clock(batch), replay_lenient if lenient else replay
        buckets.rewrite(spark, folder, epoch, own, lambda base: fold(base, log, clock), clock, bucket_rows, compact_every)

    return (
        documents.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def rejected(spark: SparkSession, root: str) -> DataFrame:
    """(epoch, json, error) of all lines that are no valid documents to a lenient merge."""
    folder = spark.read.schema("json string, error string, epoch long")
    return folder.option("basePath", f"{root}/rejected").parquet(f"{root}/rejected").select("epoch", "json", "error")


def current(spark: SparkSession, root: str, batches: int | None = None) -> DataFrame:
    """The registry after the first ``batches`` micro-batches (default: all stored ones)."""
    return buckets.registry(spark, f"{root}/registry", batches)
