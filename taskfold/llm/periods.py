"""Runs of repeating words: Lyndon arrays by Baier's grouping, roots extended to runs.

A run's Lyndon root is the longest Lyndon word that starts there, under the order of the words or under its
reverse. The first phase of Baier's suffix sorter groups positions by just these words, so one pass of it for
each order names all roots; how far the period of a root goes on to both sides is a common extension.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taskfold.llm.tables import table

LEAST_LENGTH, LEAST_EXPONENT = 6, 4

RESULT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each position.

    Groups hold positions whose suffixes share a context: at first one word. They are taken from the highest on.
    The nearest position to the left that is in a lower group is the one whose context the members of the group
    continue. Positions that are continued by equally many members move together from their group to a new
    one right above it. A group that is taken is final, and its context is the Lyndon word of its members.
    """
    n = len(ranks)
    order = sorted(set(ranks))
    number = {rank: g for g, rank in enumerate(order)}
    of = [-1] + [number[r] for r in ranks] + [-1]  # positions count from 1; 0 and n + 1 are outside
    members: list[list[int]] = [[] for _ in order]
    for i in range(1, n + 1):
        members[of[i]].append(i)
    length = [1] * len(order)
    lower = list(range(-1, len(order) - 1))
    upper = [*range(1, len(order)), -1]
    left, right = list(range(-1, n + 1)), list(range(1, n + 3))  # positions that no taken group holds
    out = [0] * (n + 1)
    continues = [0] * (n + 2)
    group = len(order) - 1
    while group >= 0:
        size = length[group]
        times: dict[int, int] = {}
        last: dict[int, int] = {}
        for i in members[group]:
            if of[i] != group:
                continue  # it moved on
            p = left[i]
            if of[p] == group:
                p = continues[p]
            continues[i] = p
            out[i] = size
            if p:
                times[p] = times.get(p, 0) + 1
                last[p] = i
        for i in members[group]:
            if of[i] == group:
                a, b = left[i], right[i]
                right[a], left[b] = b, a
        parts: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            parts.setdefault((k, of[p]), []).append(p)
        for k, g in sorted(parts, reverse=True):  # the most continued are the highest
            moved, new = parts[k, g], len(length)
            length.append(last[moved[0]] + size - moved[0])
            members.append(moved)
            above = upper[g]
            lower.append(g)
            upper.append(above)
            upper[g] = new
            lower[above] = new
            for p in moved:
                of[p] = new
        members[group] = []
        group = lower[group]
    return out[1:]


def _common(x: np.ndarray, a: int, b: int, step: int) -> int:
    """How many values from x[a] and x[b] on are equal, to the right (step 1) or to the left (step -1)."""
    total, size = 0, 64
    limit = len(x) - max(a, b) if step > 0 else min(a, b) + 1
    while total < limit:
        k = min(size, limit - total)
        if step > 0:
            differ = x[a + total : a + total + k] != x[b + total : b + total + k]
        else:
            differ = (x[a - total - k + 1 : a - total + 1] != x[b - total - k + 1 : b - total + 1])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return total + at
        total, size = total + k, 2 * size
    return total


def _stretch_runs(ids: np.ndarray) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence."""
    found = set()
    for ranks in (ids, -ids):
        lyndon = np.array(lyndon_array(ranks.tolist()), np.int64)
        at = np.arange(len(ids))
        # of at least four periods, three whole roots follow one another
        third = at + 2 * lyndon
        whole = np.flatnonzero(third + lyndon <= len(ids))
        same = whole[(lyndon[whole + lyndon[whole]] == lyndon[whole]) & (lyndon[third[whole]] == lyndon[whole])]
        known: dict[int, tuple[int, int]] = {}  # the last run of a period
        for a in same.tolist():
            p = int(lyndon[a])
            start, end = known.get(p, (0, -1))
            if start <= a and a + 2 * p <= end:
                continue
            back = _common(ids, a - 1, a + p - 1, -1) if a else 0
            start, end = a - back, a + p + _common(ids, a, a + p, 1)
            known[p] = start, end
            if end - start >= max(LEAST_LENGTH, LEAST_EXPONENT * p):
                found.add((start, end - start, p))
    return found


def word_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs with a length of at least max(6, 4 * period), by start, then period.

    Every word of such a run stands in it four times, so a word that is rarer lies in none and parts the
    sequence; the same holds again in each part.
    """
    counts = Counter(words)
    often = {w: i for i, w in enumerate(w for w, k in counts.items() if k >= LEAST_EXPONENT)}
    if not often:
        return []
    ids = np.array([often.get(w, -1) for w in words], np.int64)
    out, work = [], [(0, ids, ids >= 0)]
    while work:
        first, part, usable = work.pop()
        edge = np.flatnonzero(np.diff(np.concatenate([[0], usable.astype(np.int8), [0]])))
        for low, high in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if high - low < LEAST_LENGTH:
                continue
            own = part[low:high]
            _, own, k = np.unique(own, return_inverse=True, return_counts=True)
            frequent = k[own] >= LEAST_EXPONENT
            if frequent.all():
                out += [(first + low + s, length, p) for s, length, p in _stretch_runs(own)]
            elif frequent.any():
                work.append((first + low, own, frequent))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that repeat the first period of a run."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def looped(words: list, doc_id: int | None) -> list:
    """The contract's change of each tenth document: from a word on, it repeats what follows."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a : a + p]
    return words[:a] + (loop * (-(-(n - a) // p)))[: n - a]


def periodic_runs(docs: DataFrame, loops: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_runs, the longest run (start, length, period, exponent_milli; ties: smallest
    start, then period; nulls without a run), runs_sha256, collapsed_sha256, ``runs`` (all of them), ``collapsed``
    (the words that stay, joined by a space).

    Words are parted by ASCII white space and compared as they are. A run is a stretch of at least
    max(6, 4 * period) words that repeats its smallest period and can't be made longer. A word goes if a run
    holds it after that run's first period. With ``loops`` each tenth document, by a hash of its id, is given a
    loop first (see ``looped``); rows without an id never are.

    Rows are taken one by one: null and empty texts have no words and no run, repeated rows come out alike,
    and other columns are not looked at. A text is read whole by one task.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        types = [pa.int64()] * 6 + [pa.string()] * 2 + [run_type, pa.string()]
        names = [part.split()[0] for part in RESULT.split(", ")]
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                doc_id, text = ids[i].as_py(), texts[i].as_py()
                words = (text or "").encode().split()
                if loops:
                    words = looped(words, doc_id)
                runs = word_runs(words)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
                kept = b" ".join(collapsed(words, runs))
                start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
                exponent = 1000 * length // period if runs else None
                rows.append((
                    doc_id, len(runs), start, length, period, exponent,
                    hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest(),
                    [{"start": s, "length": n, "period": p} for s, n, p in runs], kept.decode(),
                ))
                size += len(kept)
                if size > 1 << 24 or len(rows) >= 2000:
                    yield flush()
                    size = 0
        if rows:
            yield flush()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(found, RESULT)


def op13_periodic_runs(spark, sf_dir) -> DataFrame:
    """Runs of repeating words of all documents, each tenth of which is given a loop; see ``periodic_runs``."""
    return periodic_runs(table(spark, sf_dir, "documents"), loops=True).drop("runs", "collapsed")
