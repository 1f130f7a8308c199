"""Running a document stream over arrivals, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taskfold.session import scratch_path
from taskfold.streaming import keyed_state, merge


def arrive(documents: DataFrame, inbox: str) -> None:
    """Add documents to the inbox as JSON lines."""
    documents.write.mode("append").json(inbox)


def merged_by_batches(
    spark: SparkSession, arrivals: list[DataFrame], lenient: bool = False, compact_every: int = 1
) -> DataFrame:
    """Feed arrivals to :func:`taskfold.streaming.merge.merge_stream`, wait, and read the registry."""
    root = scratch_path(spark, "registry")
    for documents in arrivals:
        arrive(documents, f"{root}/inbox")
        stream = merge.document_stream(spark, f"{root}/inbox")
        merge.merge_stream(stream, root, f"{root}/checkpoint", compact_every, lenient).awaitTermination()
    return merge.current(spark, root)


def rejects_of_lines(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Feed lines of text (``value``) to a lenient merge and read what it rejected."""
    root = scratch_path(spark, "registry")
    lines.write.text(f"{root}/inbox")
    stream = merge.document_stream(spark, f"{root}/inbox")
    merge.merge_stream(stream, root, f"{root}/checkpoint", lenient=True).awaitTermination()
    return merge.rejected(spark, root)


def merged_by_keyed_state(spark: SparkSession, arrivals: list[DataFrame], as_of: int, slices: int = 1) -> DataFrame:
    """The same through the state store and its change feed, kept in a Parquet sink. ``slices`` as in :func:`keyed_state.change_feed`."""
    root = scratch_path(spark, "feed")
    keyed_state.use_rocksdb(spark)
    for documents in arrivals:
        arrive(documents, f"{root}/inbox")
        stream = merge.document_stream(spark, f"{root}/inbox")

        def keep(feed: DataFrame, epoch: int) -> None:
            feed.write.mode("overwrite").parquet(f"{root}/feed/epoch={epoch}")

        (
            keyed_state.change_feed(stream, slices)
            .writeStream.outputMode("update")
            .foreachBatch(keep)
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    return keyed_state.latest_items(keyed_state.stored_feed(spark, f"{root}/feed"), as_of)
