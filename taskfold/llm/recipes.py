"""Exact dedup by chunk recipes: texts are equal if their lists of verified chunk identifiers are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from taskfold.llm import bytetext as bt
from taskfold.llm.chunks import _digests, chunks
from taskfold.llm.tables import dropped, stored, table

#: A chunk ends on average every 2**BITS bytes and after CHUNK_BYTES at the latest.
BITS, CHUNK_BYTES = 10, 1 << 16
#: A group with more than this share of all rows is met by broadcast: there can't be more than 1 / share of them.
HOT_SHARE = 0.001
_NUMBERS = "array<struct<pos:int,number:long>>"


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with each run of white space as one space."""
    space = ~bt.BY_SPACE[data]
    again = np.zeros_like(space)
    again[1:] = space[1:] & space[:-1]
    again[offsets[:-1][offsets[:-1] < len(data)]] = False
    before = np.concatenate([[0], np.cumsum(~again)])
    return np.where(space, np.uint8(32), data)[~again], before[offsets]


def cut(data: np.ndarray, offsets: np.ndarray, bits: int):
    """(start, end, text number) of the chunks: content-defined ends, and some more in chunks that get too long."""
    starts, ends, owner = chunks(data, offsets, bits)
    more = (ends - starts - 1) // CHUNK_BYTES
    if more.any():
        of = np.repeat(np.arange(len(starts)), more + 1)
        step = np.arange(len(of)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
        starts, ends = starts[of] + step * CHUNK_BYTES, np.minimum(starts[of] + (step + 1) * CHUNK_BYTES, ends[of])
        owner = owner[of]
    return starts, ends, owner


def _chunk_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest_bits: int) -> np.ndarray:
    digest = _digests(data, starts, ends) if len(starts) else np.empty(0, np.int64)
    return digest if digest_bits == 64 else digest & np.int64((1 << digest_bits) - 1)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _recipe_rows(bits: int, digest_bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in bt.slices(batch.column(1)):
                data, offsets = normalised(data, offsets)
                starts, ends, owner = cut(data, offsets, bits)
                view = memoryview(np.ascontiguousarray(data))
                sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                counts = np.bincount(owner, minlength=end - first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:end], bt.list_array(_chunk_digests(data, starts, ends, digest_bits), counts),
                     pa.array(np.diff(offsets)), pa.array(sha, pa.string())],
                    ["doc_id", "ids", "n_bytes", "text_sha256"],
                )

    return rows


def _chunk_rows(bits: int, digest_bits: int, places: bool):
    """(digest, bytes) of the chunks of each slice, each once; with ``places`` of all, with document and position."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in bt.slices(batch.column(1)):
                data, offsets = normalised(data, offsets)
                starts, ends, owner = cut(data, offsets, bits)
                digest = _chunk_digests(data, starts, ends, digest_bits)
                # the chunks of a slice follow one another, so their ends cut its bytes
                edges = np.concatenate([starts, ends[-1:]]).astype(np.int32)
                pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)])
                if not places:
                    yield pa.RecordBatch.from_arrays([pa.array(digest), pieces], ["digest", "bytes"])
                    continue
                view = memoryview(np.ascontiguousarray(data))
                sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                pos = np.arange(len(owner)) - np.searchsorted(owner, owner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:end].take(pa.array(owner)), pa.array(sha, pa.string()).take(pa.array(owner)),
                     pa.array(pos.astype(np.int32)), pa.array(digest), pieces],
                    ["doc_id", "text_sha256", "pos", "digest", "bytes"],
                )

    return rows


def chunk_table(docs: DataFrame, bits: int = BITS, digest_bits: int = 64) -> DataFrame:
    """(digest, number, bytes, uses) of all different chunks of the normalised texts.

    (digest, number) is a chunk's verified identifier: chunks with equal digests but different bytes get
    different numbers, by the order of the bytes; nearly always the number is 0. Chunks are counted where they
    are cut and cross the network once each, however many texts hold them.
    """
    own = _different(docs, bits, digest_bits)
    number = F.row_number().over(Window.partitionBy("digest").orderBy("bytes")) - 1
    return own.select("digest", number.cast("long").alias("number"), "bytes", "uses")


def _different(docs: DataFrame, bits: int, digest_bits: int) -> DataFrame:
    rows = _texts(docs).mapInArrow(_chunk_rows(bits, digest_bits, False), "digest long, bytes binary")
    return rows.groupBy("digest", "bytes").agg(F.count("*").alias("uses"))


def recipes(docs: DataFrame, bits: int = BITS, digest_bits: int = 64) -> DataFrame:
    """Per row of ``docs``: row (a number), doc_id, recipe (``ids``: digests of its chunks in order; ``numbers``: pos and
    number of those chunks whose identifier isn't (digest, 0)), n_bytes and text_sha256 of the normalised text.

    The texts are cut twice: once to find the digests that stand for more than one chunk, and once for the
    lists. Only if there are such digests are the bytes of these chunks looked at again.
    """
    texts = _texts(docs)
    own = texts.mapInArrow(_recipe_rows(bits, digest_bits), "doc_id long, ids array<long>, n_bytes long, text_sha256 string")
    lists = stored(own.withColumn("row", F.monotonically_increasing_id()), "recipes")  # numbers are fixed once written
    different = _different(docs, bits, digest_bits)
    doubtful = stored(different.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "doubtful")
    if doubtful.isEmpty():
        return lists.select("row", "doc_id", F.struct("ids", F.expr(f"CAST(array() AS {_NUMBERS})").alias("numbers")).alias("recipe"), "n_bytes", "text_sha256")
    number = F.row_number().over(Window.partitionBy("digest").orderBy("bytes")) - 1
    numbered = different.join(doubtful, "digest", "left_semi").select("digest", "bytes", number.cast("long").alias("number"))
    places = texts.mapInArrow(
        _chunk_rows(bits, digest_bits, True), "doc_id long, text_sha256 string, pos int, digest long, bytes binary"
    )
    known = (
        places.join(doubtful, "digest", "left_semi")
        .join(numbered.filter("number > 0"), ["digest", "bytes"])
        .groupBy("doc_id", "text_sha256")  # rows that share both hold the same text
        .agg(F.sort_array(F.collect_set(F.struct("pos", "number"))).alias("numbers"))
    )
    a, b = lists.alias("a"), known.alias("b")
    return a.join(b, F.expr("a.doc_id <=> b.doc_id AND a.text_sha256 = b.text_sha256"), "left").select(
        "a.row", "a.doc_id",
        F.struct("a.ids", F.coalesce("b.numbers", F.expr("array()")).cast(_NUMBERS).alias("numbers")).alias("recipe"),
        "a.n_bytes", "a.text_sha256",
    )


def exact_duplicates(docs: DataFrame, bits: int = BITS, digest_bits: int = 64, hot_share: float = HOT_SHARE) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id (smallest doc_id with an equal text), group_size (rows), kept, text_sha256,
    n_bytes, n_chunks.

    Texts are equal if they are so once each run of white space is a space. They are cut into content-defined
    chunks, chunks are deduplicated to verified identifiers, and texts are compared by their lists of these, so
    long texts move to no place where they are compared. Of a group exactly one row stays: with the smallest doc_id, and
    of equal ones any (they are alike). A null doc_id comes after all others; a null text is empty.

    Groups are counted before the shuffle, so a group of a third of all rows costs a row per task. Each row then gets
    its group's answer: groups with more than ``hot_share`` of all rows are sent to the rows (their number is
    bounded by that share, their lists by the mean length over it), the others are joined.
    """
    lists = recipes(docs, bits, digest_bits)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = lists.groupBy("recipe").agg(F.count("*").alias("group_size"), F.min(first).alias("first"))
    groups = stored(groups.filter("group_size > 1"), "groups")
    total = lists.count()
    hot = groups.filter(F.col("group_size") > hot_share * total)
    rest = lists.join(F.broadcast(hot.select("recipe")), "recipe", "left_anti")
    met = lists.join(F.broadcast(hot), "recipe").unionByName(
        rest.join(groups.filter(F.col("group_size") <= hot_share * total), "recipe", "left")
    )
    return met.select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
        "n_bytes",
        F.size("recipe.ids").cast("long").alias("n_chunks"),
    )


def op12_exact_dedup(spark, sf_dir) -> DataFrame:
    """Groups of equal texts of all documents; see ``exact_duplicates``."""
    return exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP12_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(s) AS text_sha256
FROM t WINDOW same AS (PARTITION BY s)
"""
