"""Replay that skips invalid documents, as a user would who re-runs the tool after each error.

A document is atomic over many items, and whether it is valid depends on which earlier documents
were. Only *contested* items matter, those with a needy change (an upsert that could not create its
item), and of those only a few bytes per document:

* a document without a needy change is always valid;
* a needy change is fine if its item is alive before the document, and sinks the document if it is absent.

So the contested rows are sorted by project and document over ranges, and each range is walked once as a stream
that remembers the items whose state is no longer that of the registry. A range that begins inside a project doesn't know what
the ranges before it left behind. There it keeps three states, alive, absent and unknown, which decide most
documents all the same; those they can't are passed on with the little that their answer depends on, and so
are the states at the range's end. A second stream per project, over these leftovers alone, decides them in
order. A chain of documents that each hang on the one before thus takes two passes, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taskfold.operators.changelog import bad_status_documents, missing_field, replay
from taskfold.operators.skew import HEAVY_ROWS
from taskfold.schema import KEY, REMOVE, UPSERT
from taskfold.session import stored

VALID, INVALID = 1, -1
DOCUMENT = ["project_id", "batch_seq"]


def item_touches(log: DataFrame) -> DataFrame:
    """One row per item and document: does it end absent (``dead``), did it have to exist (``needy``)?"""
    upsert = F.col("op_rank") == UPSERT
    return log.groupBy(*KEY, "batch_seq").agg(
        (F.max("op_rank") == REMOVE).alias("dead"),
        F.coalesce(
            F.min_by(missing_field().isNotNull(), F.when(upsert, F.col("pos"))), F.lit(False)
        ).alias("needy"),
    )


def document_verdicts(log: DataFrame, base: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """(project_id, batch_seq, accepted) for every document of the log.

    ``ranges``: into how many ranges the contested rows are cut (default: as many as the session shuffles into).
    """
    rejected = rejected_documents(log, base, ranges)
    return (
        log.select(*DOCUMENT)
        .distinct()
        .join(rejected.withColumn("_rejected", F.lit(True)), DOCUMENT, "left")
        .select(*DOCUMENT, F.col("_rejected").isNull().alias("accepted"))
    )


def rejected_documents(log: DataFrame, base: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """(project_id, batch_seq) of the documents that are not valid, of :func:`document_verdicts`."""
    bad = bad_status_documents(log)
    readable = log.join(bad, DOCUMENT, "left_anti")
    touches = item_touches(readable)
    needy_items = touches.filter("needy").select(*KEY).distinct()
    contested = touches.join(needy_items, list(KEY), "left_semi")
    if base is None:
        contested = contested.withColumn("base_alive", F.lit(False))
    else:
        known = base.select(*KEY, F.lit(True).alias("base_alive"))
        contested = contested.join(known, list(KEY), "left").withColumn(
            "base_alive", F.coalesce("base_alive", F.lit(False))
        )
    contested = stored(contested, "touches")
    invalid = _decided(contested, ranges).filter(F.col("verdict") == INVALID)
    return bad.unionByName(invalid.select(*DOCUMENT))


#: What a walk leaves: ``kind`` 0 is a verdict, 1 a touch of a document not decided (``state``: that of the item before it as
#: far as the range knows), 2 the state of an item at the end of a range. ``place`` orders the rows of a project.
_LEFT = "project_id string, batch_seq long, kind int, id string, needy boolean, dead boolean, base_alive boolean, state int, verdict int, place struct<range:int,row:long>"


def _decided(contested: DataFrame, ranges: int | None) -> DataFrame:
    """(project_id, batch_seq, verdict) of the documents with a needy change, in two passes and one table between."""
    first = contested.select("project_id").distinct().select("project_id", F.lit(True).alias("begins"))
    rows = contested.withColumn("begins", F.lit(False)).unionByName(first, allowMissingColumns=True)
    order = ["project_id", F.col("batch_seq").asc_nulls_first(), "id"]
    cut = [*([ranges] if ranges else []), "project_id", F.col("batch_seq").asc_nulls_first()]
    sorted_ = rows.repartitionByRange(*cut).sortWithinPartitions(*order)
    slim = sorted_.select("project_id", "batch_seq", "id", "needy", "dead", "base_alive", "begins", F.spark_partition_id().alias("range"))
    walked = stored(slim.mapInArrow(_walker(), _LEFT), "verdicts")
    left = walked.filter("kind > 0").repartition("project_id").sortWithinPartitions("project_id", "place")
    late = left.select(*walked.columns[:-1]).mapInArrow(_finisher(), "project_id string, batch_seq long, verdict int")
    return walked.filter("kind = 0").select(*DOCUMENT, "verdict").unionByName(late)


def _walker():  # closures, so that workers need not import this package
    alive, absent, unknown = 1, 0, -1
    valid, invalid = VALID, INVALID
    fields = [("project_id", pa.string()), ("batch_seq", pa.int64()), ("kind", pa.int32()), ("id", pa.string()), ("needy", pa.bool_()),
              ("dead", pa.bool_()), ("base_alive", pa.bool_()), ("state", pa.int32()), ("verdict", pa.int32()),
              ("place", pa.struct([("range", pa.int32()), ("row", pa.int64())]))]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state: dict[str, int] = {}
        number = 0

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(fields)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])

        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))))
        for project, of_project in groupby(rows, key=lambda r: r[0]):
            whole = False  # whether the range holds the project from its first document on
            state = {}  # where it isn't that of the registry, or, in a part, where anything is known
            for seq, touches in groupby(of_project, key=lambda r: r[1]):
                touches = list(touches)
                if touches[0][6]:
                    whole = True
                    del touches[0]
                    if not touches:
                        continue
                part = touches[0][7]
                before = [state.get(t[2], int(t[5]) if whole else unknown) for t in touches]
                needs = [b for b, t in zip(before, touches) if t[3]]
                verdict = invalid if absent in needs else None if unknown in needs else valid
                if verdict is None:
                    for b, (_, _, item, needy, dead, base, _, _) in zip(before, touches):
                        number += 1
                        out.append((project, seq, 1, item, needy, dead, base, b, None, {"range": part, "row": number}))
                        if b != (absent if dead else alive):
                            state[item] = unknown
                else:
                    if needs:
                        number += 1
                        out.append((project, seq, 0, None, None, None, None, None, verdict, {"range": part, "row": number}))
                    if verdict == valid:
                        for t in touches:
                            now = absent if t[4] else alive
                            if whole and now == int(t[5]):
                                state.pop(t[2], None)
                            else:
                                state[t[2]] = now
                if len(out) >= 10_000:
                    yield batch_of()
        # only the last project may go on in the next range, which may ask for these
        for item, now in state.items():
            if now != unknown:
                number += 1
                out.append((project, None, 2, item, None, None, None, now, None, {"range": part, "row": number}))
                if len(out) >= 10_000:
                    yield batch_of()
        yield batch_of()

    return walk


def _finisher():
    unknown, valid, invalid = -1, VALID, INVALID

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["project_id", "batch_seq", "verdict"])

        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))))
        for project, of_project in groupby(rows, key=lambda r: r[0]):
            state: dict[str, int] = {}
            for (seq, kind), part in groupby(of_project, key=lambda r: (r[1], r[2])):
                if kind == 2:
                    state.update((r[3], r[7]) for r in part)
                    continue
                part = list(part)
                before = [state.get(r[3], int(r[6])) if r[7] == unknown else r[7] for r in part]
                fine = all(b for b, r in zip(before, part) if r[4])
                out.append((project, seq, valid if fine else invalid))
                state.update((r[3], int(not r[5]) if fine else b) for b, r in zip(before, part))
                if len(out) >= 10_000:
                    yield batch_of()
        yield batch_of()

    return finish


def replay_lenient(
    base: DataFrame, log: DataFrame, as_of: int | DataFrame, min_heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """The registry after all valid documents; invalid ones leave no trace."""
    accepted = log.join(rejected_documents(log, base), DOCUMENT, "left_anti")
    few = log.count() <= min_heavy_rows  # then no item has more changes than that, and the accepted need no look
    return replay(base, accepted, as_of, check=False, min_heavy_rows=None if few else min_heavy_rows)
