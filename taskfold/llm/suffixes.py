"""Suffix-array dedup: sorted runs of front-coded suffixes, exchanged and merged without comparing known prefixes.

Sorting every suffix of a corpus would move many times its size. Here only suffixes that can matter are sorted:

* Every window of 50 bytes picks the byte at which its smallest 20-byte hash begins. Equal windows pick the same place,
  so a string that two documents share has a common anchor in both. About one byte in sixteen is an anchor.
* Anchors whose 20 bytes stand in one document only can't lie in a repeated string, and drop out.
* The suffixes at the others, 50 bytes to the right and then 30 to the left, make sorted runs in each task. They
  are front-coded (bytes in common with the one before, and the rest), exchanged by their first 20 bytes, and
  merged by a loser tree that knows the common prefixes. Neighbours and their common prefixes in that order
  tell for each of the windows around an anchor which document has it first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taskfold.llm import bytetext as bt
from taskfold.llm.tables import dropped, stored, table

U = np.uint64
LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM  # windows around an anchor begin up to this many bytes before it
KEY = LENGTH + REACH + 2  # right context, left context outwards, and how much of both there is
PIECE = bt.SLICE_BYTES
ASK_ROWS, RUN_ROWS = 250_000, 60_000
_MAX = U(2**64 - 1)


def _extreme(values: np.ndarray, pick, fill: np.uint64) -> np.ndarray:
    """Smallest or largest of the 31 values from each place on."""
    out = values
    for step in (1, 2, 4, 8, 15):  # 2, 4, 8, 16 and 31 values
        moved = np.full_like(out, fill)
        moved[:-step or None] = out[step:] if step < len(out) else fill
        out = pick(out, moved)
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash of 20 bytes, text number) of all anchors, in order."""
    if len(offsets) == 2 and len(data) > PIECE + LENGTH:
        parts = []
        for at in range(0, len(data) - LENGTH + 1, PIECE):
            piece = data[at : at + PIECE + LENGTH - 1]
            p, h, _ = anchors(piece, np.array([0, len(piece)]))
            parts.append((p + at, h))
        place, first = np.unique(np.concatenate([p for p, _ in parts]), return_index=True)
        return place, np.concatenate([h for _, h in parts])[first], np.zeros(len(place), np.int64)
    n = len(data)
    none = np.empty(0, np.int64)
    if n < LENGTH:
        return none, np.empty(0, U), none
    sums = bt.prefix_sums(data)
    starts = np.arange(n - GRAM + 1)
    hashes = np.full(n, _MAX)
    hashes[: n - GRAM + 1] = bt.range_hashes(sums, starts, starts + GRAM) >> U(1)
    inside = np.zeros(n + 1, np.int32)  # whether a window that begins here ends in the same text
    size = np.diff(offsets)
    enough = size >= LENGTH
    np.add.at(inside, offsets[:-1][enough], 1)
    np.add.at(inside, (offsets[1:] - LENGTH + 1)[enough], -1)
    least = _extreme(hashes, np.minimum, _MAX)
    least[np.cumsum(inside[:-1]) == 0] = 0
    chosen = _extreme(least[::-1], np.maximum, U(0))[::-1] == hashes
    place = np.flatnonzero(chosen & (hashes > 0))
    return place, hashes[place], np.searchsorted(offsets, place, "right") - 1


_ASKED = "part long, doc_id long, keys binary, docs binary, numbers array<int>"


def _asker(parts: int):
    """Rows of two kinds. With a doc_id: numbers of its anchors that another document of this task has too.
    With a part: the anchors of the task for which that part's hashes are to tell; one for each of those hashes, and
    all of a document that alone has a hash here."""

    def flush(found: list) -> Iterator[dict]:
        h, doc, number = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((number, doc, h))
        h, doc, number = h[order], doc[order], number[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(h)]]) - 1
        repeated = np.repeat(doc[first] != doc[last], last - first + 1)
        by_doc = np.flatnonzero(repeated)[np.argsort(doc[repeated], kind="stable")]
        for own in np.split(by_doc, np.flatnonzero(np.diff(doc[by_doc])) + 1) if len(by_doc) else ():
            yield {"part": None, "doc_id": int(doc[own[0]]), "keys": None, "docs": None, "numbers": number[own]}
        sent = np.flatnonzero(new | ~repeated)
        part = ((h[sent] >> U(31)) * U(parts) >> U(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part)) + 1
        for own in np.split(sent, cuts):
            p = int((h[own[0]] >> U(31)) * U(parts) >> U(32))
            yield {"part": p, "doc_id": None, "keys": h[own].tobytes(), "docs": doc[own].tobytes(), "numbers": number[own]}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("numbers", pa.list_(pa.int32()))])
        found, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, _, data, offsets in bt.slices(batch.column(1)):
                _, h, owner = anchors(data, offsets)
                found.append((h, ids[first:][owner], _numbers(owner)))
                n += len(h)
                if n > 500_000:
                    yield pa.RecordBatch.from_pylist(list(flush(found)), schema)
                    found, n = [], 0
        if n:
            yield pa.RecordBatch.from_pylist(list(flush(found)), schema)

    return ask


def _numbers(owner: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... in each text."""
    first = np.searchsorted(owner, owner)
    return (np.arange(len(owner)) - first).astype(np.int32)


def _told(asked: pa.Table) -> pa.Table:
    """(doc_id, number) of the anchors of one part whose hash more than one document has."""
    read = lambda name, kind: np.frombuffer(b"".join(asked.column(name).to_pylist()), kind)
    h, doc = read("keys", U), read("docs", np.int64)
    number = asked.column("numbers").combine_chunks().flatten().to_numpy()
    order = np.lexsort((doc, h))
    h, doc, number = h[order], doc[order], number[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    last = np.concatenate([first[1:], [len(h)]]) - 1
    repeated = np.repeat(doc[first] != doc[last], last - first + 1)
    return pa.table({"doc_id": doc[repeated], "number": number[repeated]})


# --- runs ------------------------------------------------------------------------------------------


def contexts(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys of the suffixes at the places: up to 50 bytes to the right, up to 30 to the left (the nearest first),
    zeros where the text has none, then the number of bytes of both."""
    right, left = np.minimum(LENGTH, len(text) - place), np.minimum(REACH, place)
    out = np.zeros((len(place), KEY), np.uint8)
    i = np.arange(LENGTH)
    at = place[:, None] + i
    out[:, :LENGTH] = np.where(i < right[:, None], text[np.minimum(at, len(text) - 1)], 0)
    i = np.arange(REACH)
    at = place[:, None] - 1 - i
    out[:, LENGTH:-2] = np.where(i < left[:, None], text[np.maximum(at, 0)], 0)
    out[:, -2], out[:, -1] = right, left
    return out


def front_coded(keys: np.ndarray) -> tuple[bytes, bytes]:
    """(bytes in common with the key before, the remaining bytes) of sorted distinct keys."""
    common = np.zeros(len(keys), np.uint8)
    common[1:] = (keys[1:] != keys[:-1]).argmax(axis=1)
    rest = keys[np.arange(KEY) >= common[:, None]]
    return common.tobytes(), rest.tobytes()


def decoded(common: bytes, rest: bytes) -> Iterator[tuple[bytes, int]]:
    """(key, bytes in common with the key before)."""
    key, at = b"", 0
    for c in common:
        end = at + KEY - c
        key = key[:c] + rest[at:end]
        at = end
        yield key, c


def merged(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """(key, run, bytes in common with the key before) of all runs in order, by a tree of losers.

    ``known`` holds how much each run's head has in common with the last key that beat it. Of two heads that were
    beaten by the same key, the one with more in common comes first, without a look at either; only where both
    have as much are bytes compared, and those from there on. What a new head has in common with the key before
    it is what the front coding says.
    """
    k = len(runs)
    heads: list[bytes | None] = [None] * k
    known = [0] * k

    def advance(run: int) -> None:
        heads[run], known[run] = next(runs[run], (None, 0))

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's ``known`` then counts from the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        at = known[a]
        differ = int.from_bytes(x[at:], "big") ^ int.from_bytes(y[at:], "big")
        common = KEY - (differ.bit_length() + 7) // 8
        won, lost = (b, a) if common < KEY and y[common] < x[common] else (a, b)
        known[lost] = common
        return won, lost

    for run in range(k):
        advance(run)
        known[run] = 0
    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if k else 0
    while k and heads[best] is not None:
        yield heads[best], best, known[best]
        advance(best)
        node = (best + k) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def _key_hash(keys: np.ndarray) -> np.ndarray:
    flat = np.ascontiguousarray(keys).ravel()
    at = np.arange(len(keys)) * KEY
    return bt.range_hashes(bt.prefix_sums(flat), at, at + KEY) if len(keys) else np.empty(0, U)


_SUFFIXES = pa.schema([("part", pa.int64()), ("common", pa.binary()), ("rest", pa.binary()), ("docs", pa.binary()), ("key", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])
_SUFFIXES_SQL = "part long, common binary, rest binary, docs binary, key long, doc_id long, place long"


def _runner(parts: int):
    """Rows of two kinds. With a part: a sorted run of the task's distinct suffixes for it, front-coded, with the
    smallest and largest document of each. With a key: where that suffix stands."""

    def flush(found: list) -> Iterator[pa.RecordBatch]:
        keys, doc, place = (np.concatenate(x) for x in zip(*found))
        h, nothing = _key_hash(keys).view(np.int64), len(keys)
        null = pa.nulls
        yield pa.RecordBatch.from_arrays(
            [null(nothing, pa.int64()), *(null(nothing, pa.binary()) for _ in range(3)), pa.array(h), pa.array(doc), pa.array(place)], schema=_SUFFIXES
        )
        gram = bt.mix(_gram_hash(keys))
        part = ((gram >> U(32)) * U(parts) >> U(32)).astype(np.int64)
        text = np.ascontiguousarray(keys).view(f"V{KEY}").ravel()
        order = np.lexsort((doc, h, part))
        new = np.concatenate([[True], (np.diff(part[order]) != 0) | (np.diff(h[order]) != 0)])
        one = order[new]
        last = order[np.concatenate([np.flatnonzero(new)[1:], [len(order)]]) - 1]
        largest = np.empty(len(doc), np.int64)
        largest[one] = doc[last]
        out = []
        for own in np.split(one, np.flatnonzero(np.diff(part[one])) + 1):
            names = text[own].tolist()
            own = own[sorted(range(len(own)), key=names.__getitem__)]
            common, rest = front_coded(keys[own])
            out.append({"part": int(part[own[0]]), "common": common, "rest": rest, "docs": np.column_stack([doc[own], largest[own]]).tobytes(), "key": None, "doc_id": None, "place": None})
        yield pa.RecordBatch.from_pylist(out, _SUFFIXES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            ids, numbers = batch.column(0).to_numpy(), batch.column(2)
            for first, end, data, offsets in bt.slices(batch.column(1)):
                place, _, owner = anchors(data, offsets)
                at = np.searchsorted(owner, np.arange(end - first + 1))
                for i in range(end - first):
                    wanted = numbers[first + i].values.to_numpy()
                    own = place[at[i] : at[i + 1]][np.unique(wanted[wanted < at[i + 1] - at[i]])] - offsets[i]
                    if len(own):
                        keys = contexts(data[offsets[i] : offsets[i + 1]], own)
                        found.append((keys, np.full(len(own), ids[first + i]), own))
                        n += len(own)
                if n > 80_000:
                    yield from flush(found)
                    found, n = [], 0
        if n:
            yield from flush(found)

    return run


def _gram_hash(keys: np.ndarray) -> np.ndarray:
    h = np.zeros(len(keys), U)
    for i in range(GRAM):
        h = h * U(0x9E3779B97F4A7C15) + bt.BYTE_VALUE[keys[:, i]]
    return h


def _judged(runs: pa.Table) -> pa.Table:
    """For each suffix of one part: its smallest document, and which windows around it a smaller document has, for
    that document and for all others (a bit for each number of bytes that a window begins before the anchor)."""
    docs = [np.frombuffer(x, np.int64).reshape(-1, 2).tolist() for x in runs.column("docs").to_pylist()]
    coded = zip(runs.column("common").to_pylist(), runs.column("rest").to_pylist())
    used = [0] * len(docs)
    keys, least, many, shared = [], [], [], []
    for key, run, common in merged([decoded(*c) for c in coded]):
        low, high = docs[run][used[run]]
        used[run] += 1
        if common == KEY and keys:
            many[-1] |= low != high or low != least[-1]
            least[-1] = min(least[-1], low)
        else:
            keys.append(key)
            least.append(low)
            many.append(low != high)
            shared.append(common)
    k = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY)
    least, shared = np.array(least, np.int64), np.array(shared)
    own, others = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    left = np.zeros(len(k), U)
    for before in range(REACH + 1):
        if before:
            left = left * U(0x9E3779B97F4A7C15) + bt.BYTE_VALUE[k[:, LENGTH + before - 1]]
        there = np.flatnonzero((k[:, -2] >= LENGTH - before) & (k[:, -1] >= before))
        if not len(there):
            continue
        segment = np.cumsum(shared < LENGTH - before).astype(U)  # equal to the right
        same = bt.mix(segment * U(0xD1342543DE82EF95) + left)[there]
        order = np.argsort(same)
        first = np.flatnonzero(np.concatenate([[True], np.diff(same[order]) != 0]))
        smallest = np.minimum.reduceat(least[there][order], first)
        found = np.empty(len(there), np.int64)
        found[order] = np.repeat(smallest, np.diff(np.concatenate([first, [len(there)]])))
        own[there] |= (found < least[there]).astype(np.int64) << before
        others[there] |= 1 << before
    others[~np.array(many, bool)] = 0
    some = (own | others) != 0
    return pa.table({"key": _key_hash(k[some]).view(np.int64), "least": least[some], "own": own[some], "others": others[some]})


# --- removal ---------------------------------------------------------------------------------------


def _spans(n: int, places: list[int], windows: list[int]) -> list[tuple[int, int]]:
    """Maximal byte ranges of a text of n bytes that the windows cover."""
    change = np.zeros(n + 1, np.int64)
    place, mask = np.array(places, np.int64), np.array(windows, np.int64)
    for before in range(REACH + 1):
        start = place[(mask >> before) & 1 == 1] - before
        start = start[(start >= 0) & (start + LENGTH <= n)]
        np.add.at(change, start, 1)
        np.add.at(change, start + LENGTH, -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            raw = text.as_py().encode()
            spans = _spans(len(raw), [x["place"] for x in found], [x["windows"] for x in found])
            edges = [0, *(e for s in spans for e in s), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        columns = list(zip(*out)) if out else [[]] * 6
        types = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept for every row of ``docs`` (doc_id, text).

    Each byte that a 50-byte string covers which also starts in a document with a smaller doc_id is removed. Strings
    are judged on the input and never cross documents. ``kept`` is the rest as text; bytes of a character that was
    cut in two are replaced in it, but not in its digest.

    Texts that a smaller document has as a whole are settled by their digest, so exact copies, however many, are
    never searched. Tasks send one entry for equal anchors and suffixes, so a passage in a third of all documents
    costs each task one.

    Null text counts as empty. Rows with a null doc_id keep all, and no other row loses anything to them. Rows that
    share a doc_id are one document, whose texts should be equal. Other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("sha", F.sha2("text", 256)).withColumn("n_bytes", F.octet_length("text").cast("long"))
    known = stored(own.select("doc_id", "sha", "n_bytes"), "digests")
    firsts = known.filter("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copies = known.join(firsts.filter("first < last").select("sha", "first"), "sha").filter("doc_id > first")
    copies = stored(copies.select("doc_id", "sha", "n_bytes"), "copies")
    copied = copies.select("doc_id").distinct()
    total = known.agg(F.sum("n_bytes")).first()[0] or 0
    texts = own.filter(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= LENGTH)).select("doc_id", "text")
    texts = texts.join(copied.hint("shuffle_hash"), "doc_id", "left_anti")

    asked = stored(texts.mapInArrow(_asker(max(1, total // 16 // ASK_ROWS + 1)), _ASKED), "anchors")
    told = asked.filter("part IS NOT NULL").groupBy("part").applyInArrow(_told, "doc_id long, number int")
    here = asked.filter("doc_id IS NOT NULL").select("doc_id", F.explode("numbers").alias("number"))
    chosen = stored(told.union(here).groupBy("doc_id").agg(F.collect_set("number").alias("numbers")), "chosen")
    dropped(asked)
    n = chosen.agg(F.sum(F.size("numbers"))).first()[0] or 0
    suffixes = stored(
        texts.join(chosen.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "numbers").mapInArrow(_runner(max(1, n // RUN_ROWS + 1)), _SUFFIXES_SQL), "suffixes"
    )
    judged = suffixes.filter("part IS NOT NULL").groupBy("part").applyInArrow(_judged, "key long, least long, own long, others long")
    windows = F.expr("if(doc_id = least, own, others)")
    found = suffixes.filter("key IS NOT NULL").join(judged, "key").select("doc_id", "place", windows.alias("windows")).filter("windows <> 0")
    found = stored(found.groupBy("doc_id").agg(F.collect_list(F.struct("place", "windows")).alias("found")), "found")
    dropped(suffixes, chosen)

    cut = own.select("doc_id", "text").join(found.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "found").mapInArrow(_cut, _RESULT)
    nothing = hashlib.sha256(b"").hexdigest()
    zero = F.lit(0).cast("long")
    long_copies = copies.filter(F.col("n_bytes") >= LENGTH).select("doc_id").distinct()
    gone = own.join(long_copies.hint("shuffle_hash"), "doc_id", "left_semi").select(
        "doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(nothing).alias("kept_sha256"), F.lit("").alias("kept")
    )
    settled = found.select("doc_id").union(long_copies)
    whole = own.join(settled.hint("shuffle_hash"), "doc_id", "left_anti").select(
        "doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"), F.col("text").alias("kept")
    )
    return cut.union(gone).union(whole)


def op1_suffix_array_dedup(spark, sf_dir) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
