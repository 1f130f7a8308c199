"""Low-latency merge: the items of each project live in the stream's state store.

The key is the project, because a document is atomic over many items; the items themselves are entries
of a RocksDB map, so only those a document names are read. Invalid documents are reported and skipped
one by one. Output is a change feed with tombstones: without them a reader would keep the last rows
of a project that was emptied.

A stream whose documents each name one item, or items of one slice of a project, may be started with several slices, by a
hash of the ids: each is a key of its own, so that a project is not one task's.

Neither the documents that a trigger brings to a project nor the items they name need fit a task. Documents come
in chunks; if there are several, each is sorted and laid into the store in blocks, and the blocks are merged from there,
one of each chunk at a time. Items are kept in memory up to a number, then written back and put out.
"""

from __future__ import annotations

import heapq
import json
from itertools import chain
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from taskfold import fixed
from taskfold.functions.recency import recency_score
from taskfold.schema import FEATURE, KEY, PATCH_NAMES
from taskfold.sources.snapshots import committed

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: ``doc_no`` counts the documents of a project, or of its slice, as they were applied; ``kind`` is item, removed or rejected;
#: ``body`` is the item as JSON, or the reason of a rejection.
CHANGE_FEED = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("doc_no", T.LongType()),
    T.StructField("batch_seq", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("body", T.StringType()),
])

_BODY = T.StructType([f for f in FEATURE.fields if f.name not in ("project_id", "recency_score")])


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def change_feed(documents: DataFrame, slices: int = 1) -> DataFrame:
    """Turn a stream of change documents into the stream of resulting item states.

    Lines that are no documents name no project; they are left to the merge's folder of rejects. With more than one of
    ``slices`` a document that names items of several stops the stream: it is atomic, and no key holds all it needs. A
    stream keeps the number it was started with.
    """
    if "error" in documents.columns:
        # The filter looks at the partition as well: below the parse, where Spark would else move it, it would parse again.
        documents = documents.withColumn("_at", F.spark_partition_id()).filter("error IS NULL AND _at >= 0")
    # Lists travel as JSON: a field that is not provided is simply absent there.
    slim = documents.select(
        "project_id",
        "batch_seq",
        "batch_ts",
        F.to_json("features").alias("features"),
        F.to_json("remove_features").alias("removals"),
        *([_slice(slices).alias("slice")] if slices > 1 else []),
    )
    return slim.groupBy("project_id", *(["slice"] if slices > 1 else [])).transformWithStateInPandas(
        statefulProcessor=_processor(), outputStructType=CHANGE_FEED, outputMode="Update", timeMode="None"
    )


def _slice(slices: int) -> Column:
    """The slice all items of a document are in; the first for one that names none."""
    ids = F.filter(F.concat(F.transform("features", lambda p: p["id"]), "remove_features"), lambda i: i.isNotNull())
    slice_of = lambda i: F.pmod(F.xxhash64(i), F.lit(slices)).cast("int")
    several = F.raise_error(F.concat(F.lit("a document of several slices of project "), F.coalesce("project_id", F.lit("null"))))
    found = F.array_distinct(F.transform(ids, slice_of))
    return F.when(F.size(found) > 1, several.cast("int")).otherwise(F.coalesce(F.get(found, F.lit(0)), F.lit(0)))


#: Documents of a block in the store, items kept in memory, and rows put out at a time.
BLOCK_DOCUMENTS, KEPT_ITEMS, FEED_ROWS = 500, 20_000, 5_000


def _processor(block: int = BLOCK_DOCUMENTS, kept: int = KEPT_ITEMS, at_once: int = FEED_ROWS) -> StatefulProcessor:
    required, statuses, patch_names = fixed.REQUIRED_ON_CREATE, fixed.STATUSES, frozenset(PATCH_NAMES)
    defaults = {"status": fixed.DEFAULT_STATUS, "tags": [], "files_involved": []}
    columns, missing_field_text = CHANGE_FEED.fieldNames(), fixed.MISSING_FIELD_TEXT

    def plain(column):
        return column.tolist() if column.dtype.kind in "iu" else [json.dumps(value) for value in column.tolist()]

    class Merge(StatefulProcessor):  # defined here, so that workers need not import this package
        def init(self, handle):
            self.items = handle.getMapState("items", "id string", "body string")
            self.waiting = handle.getMapState("waiting", "run int, block int", "documents string")
            self.count = handle.getValueState("documents", "n long")

        def handleInputRows(self, key, rows, timerValues):
            self.empty = not self.count.exists()  # nothing to look up until something is written
            n = 0 if self.empty else self.count.get()[0]
            self.cache, self.touched, feed = {}, {}, []  # item -> body; item -> (document, batch) that changed it
            for doc in self.in_order(rows):
                n += 1
                try:
                    changed = self.apply(doc, n)
                except ValueError as problem:
                    feed.append((key[0], n, doc[0], "rejected", None, str(problem)))
                else:
                    for item, body in changed.items():
                        self.cache.pop(item, None)  # the last changed is the last to go
                        self.cache[item] = body
                        self.touched[item] = (n, doc[0])
                if len(self.cache) > kept:
                    self.write_back(key[0], feed, kept // 2)
                while len(feed) >= at_once:
                    yield pd.DataFrame(feed[:at_once], columns=columns)
                    del feed[:at_once]
            self.count.update((n,))
            self.write_back(key[0], feed, 0)
            for first in range(0, len(feed), at_once):
                yield pd.DataFrame(feed[first : first + at_once], columns=columns)

        def write_back(self, project, feed, leave):
            """Put the items changed longest ago into the store and the feed, until ``leave`` are left."""
            while len(self.cache) > leave:
                item = next(iter(self.cache))
                body = self.cache.pop(item)
                if item not in self.touched:
                    continue
                n, batch = self.touched.pop(item)
                text = None if body is None else json.dumps(body)
                if text is not None:
                    self.items.updateValue((item,), (text,))
                    self.empty = False
                elif not self.empty and self.items.containsKey((item,)):
                    self.items.removeKey((item,))
                feed.append((project, n, batch, "removed" if text is None else "item", item, text))

        def in_order(self, rows):
            """(batch_seq, batch_ts, features, removals) of all documents by batch_seq."""
            rows = iter(rows)
            first, second = next(rows, None), next(rows, None)
            if second is None:
                for documents in [] if first is None else self.blocks(first):
                    yield from json.loads(documents)
                return
            sizes = []
            for run, chunk in enumerate(chain((first, second), rows)):
                sizes.append(0)
                for at, documents in enumerate(self.blocks(chunk)):
                    self.waiting.updateValue((run, at), (documents,))
                    sizes[-1] += 1
            yield from heapq.merge(*(self.run(run, size) for run, size in enumerate(sizes)), key=itemgetter(0))

        def run(self, run, size):
            for at in range(size):
                documents = json.loads(self.waiting.getValue((run, at))[0])
                self.waiting.removeKey((run, at))
                yield from documents

        def blocks(self, chunk):
            """The documents of a chunk by batch_seq, ``block`` at a time as a JSON list. Their lists are JSON already, so all
            of a block is read by one call."""
            chunk = chunk.sort_values("batch_seq", kind="stable")
            columns = plain(chunk["batch_seq"]), plain(chunk["batch_ts"]), chunk["features"].tolist(), chunk["removals"].tolist()
            documents = ["[%s,%s,%s,%s]" % document for document in zip(*columns)]
            for at in range(0, len(documents), block):
                yield "[" + ",".join(documents[at : at + block]) + "]"

        def apply(self, doc, n):
            """Items after the document (None: removed). Raises, changing nothing, if it is invalid."""
            batch, time, features, removals = doc
            changed = {}
            for pos, patch in enumerate(features):
                item = None if patch is None else patch.get("id")
                if item is None:
                    raise ValueError("change without id")
                given = {name: value for name, value in patch.items() if value is not None and name in patch_names}
                if given.get("status", statuses[0]) not in statuses:
                    raise ValueError(f"unknown status '{given['status']}'")
                old = changed[item] if item in changed else self.stored(item)
                if old is None:
                    for name in required:
                        if name not in given:
                            raise ValueError(missing_field_text % (item, name))
                    old = {"id": item, "context": None, **defaults, "created_at": time,
                           "ord_batch": batch, "ord_pos": pos}
                changed[item] = {**old, **given, "last_updated": time}
            for item in removals:
                if item is None:
                    raise ValueError("change without id")
                changed[item] = None
            return changed

        def stored(self, item):
            if item not in self.cache:
                found = not self.empty and self.items.containsKey((item,))
                self.cache[item] = json.loads(self.items.getValue((item,))[0]) if found else None
            return self.cache[item]

        def close(self):
            pass

    return Merge()


def latest_items(feed: DataFrame, as_of: int) -> DataFrame:
    """The registry a stored change feed describes: the last state of each item, tombstones left out."""
    last = feed.filter("kind <> 'rejected'").groupBy(*KEY).agg(F.max_by(F.struct("kind", "body"), "doc_no").alias("s"))
    return (
        last.filter("s.kind = 'item'")
        .select("project_id", F.from_json("s.body", _BODY).alias("b"))
        .select("project_id", "b.*")
        .withColumn("recency_score", recency_score(F.col("last_updated"), as_of))
        .select(*FEATURE.fieldNames())
    )


def stored_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The change feed kept below ``folder``: the newest compacted part and the micro-batches after it."""
    compact = max(committed(spark, folder, "compact"), default=None)
    epochs = [e for e in committed(spark, folder, "epoch") if compact is None or e > compact]
    paths = [f"{folder}/epoch={e}" for e in epochs] + ([] if compact is None else [f"{folder}/compact={compact}"])
    return spark.read.schema(CHANGE_FEED).parquet(*paths) if paths else spark.createDataFrame([], CHANGE_FEED)


def compact_feed(spark: SparkSession, folder: str) -> int | None:
    """Write the feed up to its newest micro-batch with one row an item, its last state, and without the removed.
    Rejections stay. Readers then leave out what it covers; returns the number of that micro-batch."""
    newest = max(committed(spark, folder, "epoch"), default=None)
    if newest is None or newest in committed(spark, folder, "compact"):
        return newest
    feed = stored_feed(spark, folder)
    others = [F.col(c) for c in CHANGE_FEED.fieldNames() if c not in KEY]
    last = feed.filter("kind <> 'rejected'").groupBy(*KEY).agg(F.max_by(F.struct(*others), "doc_no").alias("s"))
    living = last.filter("s.kind = 'item'").select(*KEY, "s.*").select(*CHANGE_FEED.fieldNames())
    living.unionByName(feed.filter("kind = 'rejected'")).write.mode("overwrite").parquet(f"{folder}/compact={newest}")
    return newest
