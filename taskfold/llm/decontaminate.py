"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, one scan of each text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taskfold.llm import bytetext as bt
from taskfold.llm.tables import stored, table, whole_rows, with_row

#: Bytes of items for which one automaton is built. More items are taken in as many scans as needed.
ITEM_BYTES = 1 << 20
_NORMAL = bytes(int(bt.LOWER[b]) if bt.BY_LETTERS[bt.LOWER[b]] else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_FOUND = "array<struct<first:int,end:int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows(words: list, n: int) -> set[tuple]:
    """All runs of n words; a shorter item is one window; none without words."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class Scanner:
    """The automaton over word numbers: a step per word, whatever the number of windows."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple, set[int]] = {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text.encode())]
            for window in windows(words, n):
                owners.setdefault(window, set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, of in owners.items():
            self.automaton.add_word(window, (len(window), frozenset(of)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, hit runs of words (first, end), items found."""
        words = words_of(text)
        get = self.number.get
        numbers = tuple([get(w, 0) for w in words])
        if self.empty or not any(numbers):
            return len(words), [], set()
        hit, items = bytearray(len(words)), set()
        for last, (length, of) in self.automaton.iter(numbers):
            hit[last - length + 1 : last + 1] = b"\1" * length
            items |= of
        return len(words), [m.span() for m in re.finditer(rb"\x01+", hit)], items


def original_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of runs of words."""
    at = [m.span() for m in _WORD.finditer(text.translate(_NORMAL))]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[at[a][0]]), int(chars[at[b - 1][1]])) for a, b in runs]


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _scan_with(shared, n: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, n)
        for batch in batches:
            text = batch.column(0).field("text").cast(pa.large_string())
            runs_before, items_before = (batch.column(i).to_pylist() for i in (1, 2))
            for first, end, data, offsets in bt.slices(text):
                raw = data.tobytes()
                counts, runs, items, spans = [], [], [], []
                for i in range(end - first):
                    whole = raw[offsets[i] : offsets[i + 1]]
                    n_words, found, of = scanner.scan(whole)
                    if runs_before[first + i]:
                        found = _merged(found + [(r["first"], r["end"]) for r in runs_before[first + i]])
                        of |= set(items_before[first + i])
                    counts.append(n_words)
                    runs.append([{"first": a, "end": b} for a, b in found])
                    items.append(sorted(of))
                    spans.append([{"first": a, "end": b} for a, b in original_spans(whole, found)] if found else [])
                pairs = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:end], pa.array(runs, pairs), pa.array(items, pa.list_(pa.int64())),
                     pa.array(counts, pa.int64()), pa.array(spans, pairs)],
                    ["row", "runs", "items", "n_words", "spans"],
                )

    return scan


def decontaminated(docs: DataFrame, items: DataFrame, n: int = 13, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Per row of ``docs``: ``row`` (all its columns), n_words, n_hit, ``items`` (ids with occurring windows),
    ``spans`` (character offsets of the hit runs in the original text), contaminated.

    A window is n consecutive words of an item, or a shorter item as a whole; a document word inside any
    occurrence of a window is hit; a document is contaminated if a twentieth of its words are.

    Null and empty texts have no words. Items with a null id are left out; rows that share an item_id are one
    item. Without items nothing is hit. The items go to the executors in automata over at most about
    ``item_bytes`` of text; a larger benchmark takes one scan of the documents per such part, each adding to
    what the former found. A single item is not cut.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // item_bytes))
    now = whole_rows(docs).selectExpr(
        "row", f"CAST(array() AS {_FOUND}) AS runs", "CAST(array() AS array<bigint>) AS items"
    )
    result = with_row(now, f"runs {_FOUND}, items array<long>, n_words long, spans {_FOUND}")
    for part in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own])
        found = now.select("row", "runs", "items").mapInArrow(_scan_with(shared, n), result)
        now = found if part == parts - 1 else stored(found, "scan")
    return now.withColumn("n_hit", F.expr("aggregate(runs, 0L, (s, r) -> s + r.end - r.first)")).selectExpr(
        "row", "n_words", "n_hit", "items", "spans", "n_hit > 0 AND 20 * n_hit >= n_words AS contaminated"
    )


def op2_benchmark_decontamination(spark, sf_dir) -> DataFrame:
    """Hits of all benchmark items in all documents; see ``decontaminated``."""
    found = decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = rf"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS g
  FROM i, unnest(range(1, greatest(2, len(w) - 11))) AS t(p) WHERE len(w) > 0),
places AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM windows) AS s, unnest(range(1, len(w) - n + 2)) AS t(p)),
found AS (SELECT doc_id, item_id, p, n FROM places JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM found, unnest(range(p, p + n)) AS t(q) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
