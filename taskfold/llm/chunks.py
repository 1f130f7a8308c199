"""Substring dedup: content-defined chunks cut by a gear hash, found again by digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taskfold.llm import bytetext as bt
from taskfold.llm.tables import table, whole_rows, with_row

WINDOW = 16
_GEAR = np.random.default_rng(88).integers(0, 1 << 16, 256, dtype=np.uint16)


def chunks(data: np.ndarray, offsets: np.ndarray, bits: int = 5):
    """(start, end, text number) of all chunks.

    The gear hash h = 2 * h + G[byte] is kept in 16 bits, so it depends on the last 16 bytes alone; a chunk
    ends where its top ``bits`` bits are zero, every 2**bits bytes on average. An end needs a whole window
    inside the text, lies between two characters and doesn't follow another end at once. What stands
    before a window has no say in it, so an insertion moves the chunks around it and no others.
    """
    hashes = _GEAR[data]
    for step in (1, 2, 4, 8):  # doubles the bytes summed up: 2, 4, 8, 16
        wider = hashes.copy()
        wider[step:] += hashes[:-step] << np.uint16(step)
        hashes = wider
    zero = (hashes >> np.uint16(16 - bits)) == 0
    ends = np.flatnonzero(zero)
    ends = ends[~zero[ends - 1] | (ends == 0)] + 1
    owner = np.searchsorted(offsets, ends - 1, "right") - 1
    ends = ends[(ends - offsets[owner] >= WINDOW) & (ends < len(data))]
    ends = ends[data[ends] & 0xC0 != 0x80] if len(ends) else ends
    ends = np.union1d(ends, offsets[1:][offsets[1:] > offsets[:-1]])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.empty(0, np.int64)
    return starts, ends.astype(np.int64), np.searchsorted(offsets, starts, "right") - 1


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Chunk digests. A long text is summed in pieces cut at chunk ends."""
    if len(data) <= 8 * bt.SLICE_BYTES:
        return bt.range_hashes(bt.prefix_sums(data), starts, ends).view(np.int64)
    out, at = [], 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + 4 * bt.SLICE_BYTES, "right")))
        low = starts[at]
        sums = bt.prefix_sums(data[low : ends[end - 1]])
        out.append(bt.range_hashes(sums, starts[at:end] - low, ends[at:end] - low))
        at = end
    return np.concatenate(out).view(np.int64)


def _chunk_rows(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, data, offsets in bt.slices(batch.column(1)):
                starts, ends, owner = chunks(data, offsets, bits)
                digest, owner = bt.distinct(_digests(data, starts, ends), owner)
                yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(ids[first:][owner])], ["digest", "doc_id"])

    return rows


def _runs(repeated: np.ndarray, starts: np.ndarray, ends: np.ndarray, least_run: int):
    """Byte ranges of the runs of neighbouring repeated chunks, if they are long enough."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
    low, high = starts[edge[::2]], ends[edge[1::2] - 1]
    enough = high - low >= least_run
    return low[enough], high[enough]


def deduplicated(docs: DataFrame, bits: int = 5, least_run: int = 64) -> DataFrame:
    """Per row of ``docs``: ``row`` (all its columns), ``kept`` (its text without passages that a document with
    a smaller doc_id has too), n_bytes, n_chunks, n_repeated (chunks), n_removed (bytes), n_spans, kept_sha256.

    Texts are cut into content-defined chunks. A chunk is repeated if its digest also occurs in a document with
    a smaller doc_id; runs of neighbouring repeated chunks are removed from ``least_run`` bytes on, so single
    short chunks that meet by chance stay. The first copy of a passage, and copies inside one document, stay.

    The digests are grouped with minimum and maximum alone, so a passage in a third of all documents costs one
    row per task; a document then gets back its own repeated digests. Null text counts as empty and gives an
    empty ``kept``. Rows with a null doc_id are left as they are. Rows that share a doc_id are one document.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = slim.filter("doc_id IS NOT NULL")
    rows = slim.mapInArrow(_chunk_rows(bits), "digest long, doc_id long")
    shared = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    known = (
        rows.join(shared, "digest").filter("first < doc_id").groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))
    )
    whole = whole_rows(docs).withColumn("key", F.col("row.doc_id").cast("long"))
    joined = whole.join(known.withColumnRenamed("doc_id", "key"), "key", "left").select("row", "digests")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0).field("text").cast(pa.large_string())
            lists = batch.column(1)
            for first, end, data, offsets in bt.slices(text):
                starts, ends, owner = chunks(data, offsets, bits)
                digests = _digests(data, starts, ends)
                at = np.searchsorted(owner, np.arange(end - first + 1))
                raw = data.tobytes()
                result = []
                for i in range(end - first):
                    own = slice(at[i], at[i + 1])
                    known = lists[first + i].values if lists[first + i].is_valid else None
                    whole = raw[offsets[i] : offsets[i + 1]]
                    kept, repeated, low, high = whole, 0, (), ()
                    if known is not None and len(known):
                        again = np.isin(digests[own], known.to_numpy())
                        repeated = int(again.sum())
                        low, high = _runs(again, starts[own], ends[own], least_run)
                        edges = [offsets[i], *np.column_stack([low, high]).ravel(), offsets[i + 1]]
                        kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    result.append((kept.decode("utf-8", "replace"), len(whole), int(at[i + 1] - at[i]), repeated,
                                   len(whole) - len(kept), len(low), hashlib.sha256(kept).hexdigest()))
                columns = list(zip(*result))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:end], pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.string())],
                    ["row", "kept", "n_bytes", "n_chunks", "n_repeated", "n_removed", "n_spans", "kept_sha256"],
                )

    counts = "kept string, n_bytes long, n_chunks long, n_repeated long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(cut, with_row(joined, counts))


def op8_substring_dedup(spark, sf_dir) -> DataFrame:
    """All documents without passages that earlier ones have; see ``deduplicated``."""
    return deduplicated(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_bytes", "n_chunks", "n_repeated", "n_removed", "n_spans", "kept_sha256"
    )
