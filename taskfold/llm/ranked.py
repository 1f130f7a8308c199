"""Ranked lexical search by MaxScore with bounds for pairs of terms.

Documents are taken in blocks. Of each block the index holds the posting lists of the terms asked for with their
highest impact, and for pairs of terms the list of documents with both: its highest joint impact and its best
entries. Two rare words hardly ever reach their highest impacts in one document, so bounds that add up pairs leave
out far more blocks and documents than bounds that add up words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from taskfold.llm import bytetext as bt
from taskfold.llm.tables import dropped, stored, table

_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of items for which one index is made. More items are taken in as many parts as needed.
ITEM_BYTES = 1 << 20
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 1 << 19
#: Rows to a Python worker at a time, where a row is a block.
BLOCKS_AT_ONCE = 8
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id, so that it comes last

_BLOCK = (
    "docs binary, terms binary, lengths binary, highest binary, at binary, impacts binary, "
    "pairs binary, joint binary, head_lengths binary, head_at binary, head_impacts binary"
)


def terms_of(text: str | None) -> list[bytes]:
    return _TERM.findall((text or "").encode().lower())


@dataclass(frozen=True)
class Query:
    item_id: int | None
    terms: tuple[int, ...]  # numbers in the vocabulary, lightest first
    repeats: tuple[int, ...]
    pairs: tuple[int, ...]  # number of the pair of each term with the one before; -1 for the first


@dataclass(frozen=True)
class Index:
    blocks: DataFrame
    queries: tuple[Query, ...]
    n_docs: int
    n_terms: int


class Vocabulary:
    """Terms by the hash of their bytes; a hit is compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        text = np.frombuffer(b"".join(terms), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        hashes = bt.range_hashes(bt.prefix_sums(text), self.offsets[:-1], self.offsets[1:])
        self.order = np.argsort(hashes)
        self.hashes, self.text = hashes[self.order], text

    def find(self, data: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(number of the word, number of its term) of the words that are terms; ``data`` is in lower case."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        word = np.flatnonzero(self.hashes[at] == hashes)
        term = self.order[at[word]]
        length = end[word] - start[word]
        same = length == self.offsets[term + 1] - self.offsets[term]
        for n in np.unique(length[same]).tolist():
            of = np.flatnonzero(same & (length == n))
            step = np.arange(n)
            here, there = data[start[word[of]][:, None] + step], self.text[self.offsets[term[of]][:, None] + step]
            same[of] = (here == there).all(axis=1)
        return word[same], term[same]


def _counted(terms: list[bytes]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, n (words), and the asked terms of each text with their occurrences."""
        vocabulary = Vocabulary(terms)
        for batch in batches:
            for first, end, data, offsets in bt.slices(batch.column(1)):
                hashes, owner, start, stop = bt.hashed_words(data, offsets, bt.BY_LETTERS)
                word, term = vocabulary.find(bt.LOWER[data], hashes, start, stop)
                key, times = np.unique(owner[word] * len(terms) + term, return_counts=True)
                of = key // len(terms)
                counts = np.bincount(of, minlength=end - first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:end], pa.array(np.bincount(owner, minlength=end - first).astype(np.int64)),
                     bt.list_array((key % len(terms)).astype(np.int32), counts), bt.list_array(times.astype(np.int64), counts)],
                    ["doc_id", "n", "terms", "times"],
                )

    return rows


def _pair_partners(pairs: list[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    out: dict[int, list[tuple[int, int]]] = {}
    for number, (a, b) in enumerate(pairs):
        out.setdefault(a, []).append((b, number))
    return out


def _joint_lists(spans: dict[int, slice], at: np.ndarray, impacts: np.ndarray, n_docs: int, partners: dict, k: int):
    """(pair, highest joint impact, documents, joint impacts) of the k best entries of each list that isn't empty."""
    place = np.full(n_docs, -1, np.int64)
    for a, others in partners.items():
        if a not in spans:
            continue
        mine = spans[a]
        place[at[mine]] = np.arange(mine.start, mine.stop)
        for b, number in others:
            if b not in spans:
                continue
            theirs = spans[b]
            here = place[at[theirs]]
            both = here >= 0
            if both.any():
                joint = impacts[theirs][both] + impacts[here[both]]
                docs = at[theirs][both]
                if len(joint) > k:
                    best = np.argpartition(-joint, k - 1)[:k]
                    joint, docs = joint[best], docs[best]
                yield number, int(joint.max()), docs, joint
        place[at[mine]] = -1


def _block_rows(weights: np.ndarray, pairs: list[tuple[int, int]], n_docs: int, n_terms: int, k: int, block_docs: int):
    partners = _pair_partners(pairs)

    def block(ids, n, lengths, terms, times) -> list[bytes]:
        different, back = np.unique(n, return_inverse=True)
        m = np.array([75 + 25 * int(x) * n_docs // n_terms for x in different], np.int64)[back]
        at = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        impacts = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 12 * m[at]))
        order = np.argsort(terms, kind="stable")
        at, impacts = at[order], impacts[order]
        present, first, counts = np.unique(terms[order], return_index=True, return_counts=True)
        spans = {int(t): slice(int(f), int(f + c)) for t, f, c in zip(present, first, counts)}
        highest = np.maximum.reduceat(impacts, first) if len(first) else np.empty(0, np.int64)
        joint = list(_joint_lists(spans, at, impacts, len(ids), partners, k))
        cat = lambda parts, kind: np.concatenate([np.asarray(p, kind) for p in parts] or [np.empty(0, kind)]).tobytes()
        return [
            ids.astype(np.int64).tobytes(), present.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(),
            highest.astype(np.int64).tobytes(), at.astype(np.int32).tobytes(), impacts.astype(np.int64).tobytes(),
            np.array([j[0] for j in joint], np.int32).tobytes(), np.array([j[1] for j in joint], np.int64).tobytes(),
            np.array([len(j[2]) for j in joint], np.int32).tobytes(), cat([j[2] for j in joint], np.int32), cat([j[3] for j in joint], np.int64),
        ]

    names = [part.split()[0] for part in _BLOCK.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        docs = postings = 0

        def flush() -> pa.RecordBatch:
            values = block(*(np.concatenate(c) for c in zip(*waiting)))
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names)

        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            n = batch.column(1).to_numpy()
            where = batch.column(2).offsets.to_numpy().astype(np.int64)
            terms = batch.column(2).values.to_numpy()[: where[-1]]
            times = batch.column(3).values.to_numpy()[: where[-1]]
            low = 0
            while low < len(ids):
                fits = int(np.searchsorted(where, where[low] + BLOCK_POSTINGS - postings, "right")) - 1
                high = min(len(ids), low + block_docs - docs, max(fits, low + (not waiting)))
                if high > low:
                    a, b = where[low], where[high]
                    waiting.append((ids[low:high], n[low:high], np.diff(where[low : high + 1]), terms[a:b], times[a:b]))
                    docs, postings = docs + high - low, postings + int(b - a)
                if high < len(ids) or docs >= block_docs:
                    yield flush()
                    docs = postings = 0
                low = high
        if waiting:
            yield flush()

    return rows


def build_index(docs: DataFrame, items: list[tuple[int | None, str | None]], k: int = 20, block_docs: int = BLOCK_DOCS) -> Index:
    """An index of ``docs`` for the terms of ``items`` and the pairs of neighbouring terms of each, by weight.

    Two passes: occurrences and counts (the texts are read once), then blocks with impacts and pair lists. Each
    document's postings stay in the task that read it; what is gathered are a count per term and two totals.
    """
    counted = [Counter(terms_of(text)) for _, text in items]
    terms = sorted(set().union(*counted))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not terms:
        terms = [b""]  # no word is empty: the totals are counted all the same
    rows = stored(slim.mapInArrow(_counted(terms), "doc_id long, n long, terms array<int>, times array<long>"), "postings")
    n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    having = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # one row a term
    df = dict.fromkeys(range(len(terms)), 0) | {r["term"]: r["df"] for r in having}
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in range(len(terms))], np.int64)
    number, queries, pairs = {t: i for i, t in enumerate(terms)}, [], {}
    for (item_id, _), counts in zip(items, counted):
        own = sorted((number[t] for t in counts), key=lambda t: (weights[t], t))
        links = [pairs.setdefault(ab, len(pairs)) for ab in zip(own, own[1:])]
        queries.append(Query(item_id, tuple(own), tuple(counts[terms[t]] for t in own), (-1, *links)))
    make = _block_rows(weights, list(pairs), n_docs, max(1, n_terms), k, block_docs)
    blocks = stored(rows.filter("size(terms) > 0").mapInArrow(make, _BLOCK), "blocks", **{"parquet.block.size": 1 << 24})
    dropped(rows)
    return Index(blocks, tuple(queries), n_docs, n_terms)


def _seeds(queries: tuple[Query, ...], k: int):
    """The best joint impacts of each query. A document scores at least the impact of any two of its terms, so the
    k-th best of different documents is a lower bound of the k-th best score."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.empty(0, np.int64) for _ in queries]
        for batch in batches:
            for pairs, lengths, at, impacts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                edges = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int32))])
                spans = {p: slice(a, b) for p, a, b in zip(np.frombuffer(pairs, np.int32).tolist(), edges[:-1].tolist(), edges[1:].tolist())}
                at, impacts = np.frombuffer(at, np.int32), np.frombuffer(impacts, np.int64)
                for q, query in enumerate(queries):
                    own = [(spans[p], min(query.repeats[i - 1 : i + 1])) for i, p in enumerate(query.pairs) if p in spans]
                    if not own:
                        continue
                    docs = np.concatenate([at[s] for s, _ in own])
                    value = np.concatenate([impacts[s] * r for s, r in own])
                    order = np.lexsort((-value, docs))
                    docs, value = docs[order], value[order]
                    new = np.ones(len(docs), bool)
                    new[1:] = docs[1:] != docs[:-1]
                    best[q] = np.sort(np.concatenate([best[q], value[new]]))[-k:]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best)), [len(b) for b in best])), pa.array(np.concatenate([*best, np.empty(0, np.int64)]))],
            ["item", "value"],
        )

    return rows


class Block:
    """A block of the index, searched for one query after another."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.docs, self.at, self.impacts = read("docs", np.int64), read("at", np.int32), read("impacts", np.int64)
        edges = np.concatenate([[0], np.cumsum(read("lengths", np.int32))]).tolist()
        self.lists = {t: (slice(a, b), h) for t, a, b, h in zip(read("terms", np.int32).tolist(), edges, edges[1:], read("highest", np.int64).tolist())}
        self.joint = dict(zip(read("pairs", np.int32).tolist(), read("joint", np.int64).tolist()))
        self.sum = np.zeros(len(self.docs), np.int64)

    def bounds(self, query: Query) -> list[int]:
        """bounds[i]: what the first i terms give a document at most, taken one by one or two together."""
        out = [0]
        before = before_repeats = 0
        for i, (term, repeats) in enumerate(zip(query.terms, query.repeats)):
            highest = self.lists[term][1] if term in self.lists else 0
            own = repeats * highest
            best = out[i] + own
            if i:
                joint = self.joint.get(query.pairs[i], 0)
                both = min(repeats, before_repeats)
                two = both * joint + (repeats - both) * highest + (before_repeats - both) * before if joint else 0
                best = min(best, out[i - 1] + max(own, before_repeats * before, two))
            out.append(best)
            before, before_repeats = highest, repeats
        return out

    def found(self, query: Query, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the documents that score at least ``least``; a superset of the k best if that is a
        lower bound of the k-th best score."""
        none = np.empty(0, np.int64)
        bounds = self.bounds(query)
        if bounds[-1] < least:
            return none, none
        optional = max(i for i, b in enumerate(bounds[:-1]) if b < least)  # these alone can't reach it
        some = []
        for i in range(len(query.terms) - 1, optional - 1, -1):
            if query.terms[i] in self.lists:
                span = self.lists[query.terms[i]][0]
                self.sum[self.at[span]] += query.repeats[i] * self.impacts[span]
                some.append(self.at[span])
        touched = np.unique(np.concatenate(some)) if some else none
        open_ = touched[self.sum[touched] + bounds[optional] >= least]
        for i in range(optional - 1, -1, -1):
            if not len(open_):
                break
            if query.terms[i] in self.lists:
                span = self.lists[query.terms[i]][0]
                docs = self.at[span]
                where = np.searchsorted(docs, open_)
                where[where == len(docs)] = 0
                has = docs[where] == open_
                self.sum[open_[has]] += query.repeats[i] * self.impacts[span][where[has]]
            open_ = open_[self.sum[open_] + bounds[i] >= least]
        scores = self.sum[open_]
        self.sum[touched] = 0
        return open_, scores


def _searched(queries: tuple[Query, ...], least: list[int], k: int):
    names = [part.split()[0] for part in _BLOCK.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = list(least)
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in queries]  # (documents, scores), best first
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block({name: batch.column(c)[i].as_py() for c, name in enumerate(names[:8])})
                for q, query in enumerate(queries):
                    at, scores = block.found(query, low[q])
                    if len(at):
                        docs = np.concatenate([best[q][0], block.docs[at]])
                        scores = np.concatenate([best[q][1], scores])
                        order = np.lexsort((docs, -scores))[:k]
                        best[q] = docs[order], scores[order]
                        if len(order) == k:
                            low[q] = max(low[q], int(best[q][1][-1]))
        sizes = [len(b[0]) for b in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best)), sizes)), *(pa.array(np.concatenate([*(b[c] for b in best), np.empty(0, np.int64)])) for c in (0, 1))],
            ["item", "doc_id", "score"],
        )

    return rows


def search(index: Index, k: int = 20) -> DataFrame:
    """item (number of the query), item_id, rank, doc_id, score of the k best documents of each query of the index.

    First the pair lists alone give each query a score that its k-th best document reaches at least; then the blocks
    are searched with it, and a task raises it by what it finds. A task sends k rows a query at most.
    """
    spark = index.blocks.sparkSession
    heads = index.blocks.select("pairs", "head_lengths", "head_at", "head_impacts")
    seeds = stored(heads.mapInArrow(_seeds(index.queries, k), "item long, value long"), "seeds", BLOCKS_AT_ONCE)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("value")))
    kth = seeds.withColumn("n", place).filter(F.col("n") == k).select("item", "value").collect()  # one row a query
    least = [1] * len(index.queries)
    for r in kth:
        least[r["item"]] = max(1, r["value"])
    parts = [c.split()[0] for c in _BLOCK.split(", ")][:8]
    found = stored(index.blocks.select(*parts).mapInArrow(_searched(index.queries, least, k), "item long, doc_id long, score long"), "found", BLOCKS_AT_ONCE)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    names = spark.createDataFrame([(i, q.item_id) for i, q in enumerate(index.queries)], "item long, item_id long")
    return (
        found.withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .join(F.broadcast(names), "item")
        .select("item", "item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
    )


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, item_bytes: int = ITEM_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the ``k`` highest-scoring documents of each item.

    Only scores above 0 count; equal scores are ranked by doc_id, a null one last. Null and empty texts have no
    terms; they are no documents of the statistics, and items without terms find nothing. Every row of ``items``
    is a query of its own, also where ids are null or repeated, and every row of ``docs`` a document; documents that
    agree in id and score may take each other's rank. Items go to the executors in parts of about ``item_bytes``, each of
    which takes an index and a scan of its own; a single item is not cut.
    """
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, out = max(1, -(-total // item_bytes)), None
    for part in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        index = build_index(docs, sorted(((r["item_id"], r["text"]) for r in own), key=repr), k, block_docs)
        found = search(index, k).drop("item")
        out = found if out is None else out.unionByName(found)
    return out


def op11_ranked_search(spark, sf_dir) -> DataFrame:
    """The 20 best documents of every benchmark item; see ``ranked``."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
asked AS (SELECT item_id, t, count(*) AS r FROM (SELECT item_id, unnest({_WORDS}) AS t FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t),
impact AS (
  SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))) AS v
  FROM tf JOIN weight USING (t), total),
scored AS (SELECT item_id, doc_id, CAST(sum(r * v) AS BIGINT) AS score FROM asked JOIN impact USING (t) GROUP BY ALL),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 20
"""
