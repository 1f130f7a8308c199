"""Mixing sources to target weights: Pfair windows, earliest deadline first."""

from __future__ import annotations

import heapq
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from taskfold.llm.tables import table

#: Sources that a mix may have, at most; one row for each goes through the driver.
MAX_SOURCES = 10_000
CHUNK_ROWS = 10_000


def shares(weights: Mapping[str, float], quantum: int) -> dict[str, int]:
    """Whole parts of ``quantum``, at least one each: what is over goes to the largest remainders, then by name."""
    if len(weights) > quantum:
        raise ValueError(f"{len(weights)} sources need a quantum of at least as many slots, not {quantum}")
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    total, free = sum(weights.values()), quantum - len(weights)
    exact = {s: w / total * free for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: quantum - sum(out.values())]:
        out[s] += 1
    return out


def schedule(parts: Mapping[str, int], quantum: int) -> list[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of one period of ``quantum`` slots; all counted from 0.

    Block j of a source with share a is released at floor(j * quantum / a) and due by ceil((j + 1) * quantum / a).
    Each slot goes to the released block with the earliest deadline, which on one sequence meets all
    deadlines; so at every slot each source has had its weight's worth of blocks, by less than one.
    """
    waiting = [(0, s) for s in sorted(parts)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    done = dict.fromkeys(parts, 0)
    out = []
    for slot in range(quantum if parts else 0):
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[s] + 1) * quantum // parts[s]), s))
        deadline, s = heapq.heappop(ready)
        out.append((s, done[s], done[s] * quantum // parts[s], deadline, slot))
        done[s] += 1
        if done[s] < parts[s]:
            heapq.heappush(waiting, (done[s] * quantum // parts[s], s))
    return out


def _name(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit(""))


def mixed(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    power: float = 0.5,
    block_bytes: int = 1 << 20,
    quantum: int = 1000,
    seed: str = "mix",
) -> DataFrame:
    """doc_id, source, n_bytes, block, slot, release, deadline, in_mix for every row of ``docs`` (doc_id, text, source).

    Reading by ``slot`` gives the mix. A source's documents, in an order shuffled by a hash of doc_id and ``seed``,
    are cut into blocks of ``block_bytes``; a document belongs to the block in which it begins. Blocks get slots
    by the Pfair schedule of the target ``weights``; without these a source's weight is its bytes to the given
    ``power``. Weights are rounded to parts of ``quantum``, after which the schedule repeats, so one period of
    it is all that is computed ahead; it is sent to the documents as a table of ``quantum`` rows. With more sources
    than that, the least multiple of ``quantum`` that has a slot for each takes its place.

    No document is dropped: ``in_mix`` is true before the first slot that some source can no longer fill; later
    slots of a source that has run out stay empty. A source without a weight gets no slot and is not in the mix.

    The running sums of bytes are taken in two steps, first of hash ranges of a source, then inside a range,
    so a hot source is spread over many tasks. Null text counts as empty, a null source as the empty name;
    rows with a null or repeated doc_id are placed like others. Without rows the result is empty.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _name(F.col("source")).alias("source"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
    )
    totals = slim.groupBy("source").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if weights is None:
        weights = {r["source"]: max(1, r["bytes"]) ** power for r in totals}
    quantum *= max(1, -(-len(weights) // quantum))  # every source needs a slot
    parts = shares(weights, quantum)
    period = schedule(parts, quantum)
    slot_of = {(s, j): slot for s, j, _, _, slot in period}
    blocks = {r["source"]: max(1, -(-r["bytes"] // block_bytes)) for r in totals}
    ends = [b // parts[s] * quantum + slot_of[s, b % parts[s]] for s in parts for b in [blocks.get(s, 0)]]
    horizon = min(ends, default=0)

    digits = 0
    while max((r["rows"] for r in totals), default=0) > CHUNK_ROWS * 16**digits:
        digits += 1
    rows = slim.withColumn("chunk", F.substring("key", 1, digits))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("source", "chunk").agg(F.sum("n_bytes").alias("bytes")).select(
        "source", "chunk", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("source", "chunk").orderBy("key", "n_bytes").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("n_bytes").over(inside), F.lit(0))
    placed = rows.join(chunks, ["source", "chunk"]).withColumn("block", F.floor(start / block_bytes).cast("long"))

    plan = json.dumps([{"source": s, "a": parts[s], "j": j, "r": r, "d": d, "s": t} for s, j, r, d, t in period])
    plan_rows = docs.sparkSession.range(1).select(
        F.inline(F.from_json(F.lit(plan), "array<struct<source:string,a:long,j:long,r:long,d:long,s:long>>"))
    )
    share = docs.sparkSession.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps([{"source": s, "a": a} for s, a in parts.items()])), "array<struct<source:string,a:long>>"))
    )
    at = placed.join(F.broadcast(share), "source", "left").withColumn("j", F.expr("block % a"))
    at = at.join(F.broadcast(plan_rows.drop("a")), ["source", "j"], "left")
    base = F.expr("block div a") * quantum
    return at.select(
        "doc_id",
        "source",
        "n_bytes",
        "block",
        (base + F.col("s")).alias("slot"),
        (base + F.col("r")).alias("release"),
        (base + F.col("d")).alias("deadline"),
        F.coalesce(base + F.col("s") < horizon, F.lit(False)).alias("in_mix"),
    )


BLOCK_BYTES = 1 << 16
QUANTUM = 1000


def op4_mixing_sources(spark, sf_dir) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), block_bytes=BLOCK_BYTES, quantum=QUANTUM)


OP4_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(strlen(text), 0) AS n_bytes,
    md5(concat('mix', coalesce(CAST(doc_id AS VARCHAR), ''))) AS key FROM documents),
totals AS (SELECT source, sum(n_bytes) AS bytes, pow(greatest(1, sum(n_bytes)), 0.5) AS w FROM rows GROUP BY source),
exact AS (SELECT source, bytes, w / sum(w) OVER () * ({QUANTUM} - count(*) OVER ()) AS x FROM totals),
given AS (SELECT *, {QUANTUM} - count(*) OVER () - sum(floor(x)) OVER () AS left_over,
  row_number() OVER (ORDER BY floor(x) - x, source) AS turn FROM exact),
parts AS (SELECT source, bytes, CAST(1 + floor(x) + (turn <= left_over)::INT AS BIGINT) AS a FROM given),
lists AS (SELECT list(a ORDER BY source) AS a, list(source ORDER BY source) AS names, count(*) AS n FROM parts),
slots AS (
  SELECT CAST(0 AS BIGINT) AS t, [CAST(0 AS BIGINT) FOR x IN a] AS done, CAST(NULL AS BIGINT) AS pick FROM lists
  UNION ALL
  SELECT t + 1, [done[i] + (i = p)::BIGINT FOR i IN range(1, n + 1)], p
  FROM (SELECT s.t, s.done, l.n,
      list_sort([[((done[i] + 1) * {QUANTUM} + a[i] - 1) // a[i], i] FOR i IN range(1, n + 1)
                 IF done[i] < a[i] AND done[i] * {QUANTUM} // a[i] <= s.t])[1][2] AS p
    FROM slots s, lists l WHERE s.t < {QUANTUM})),
plan AS (
  SELECT names[pick] AS source, a[pick] AS a, done[pick] - 1 AS j, t - 1 AS s,
    (done[pick] - 1) * {QUANTUM} // a[pick] AS r, (done[pick] * {QUANTUM} + a[pick] - 1) // a[pick] AS d
  FROM slots, lists WHERE pick IS NOT NULL),
placed AS (
  SELECT *, CAST(coalesce(sum(n_bytes) OVER (PARTITION BY source ORDER BY key, n_bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    // {BLOCK_BYTES} AS BIGINT) AS block FROM rows),
horizon AS (
  SELECT min(b // p.a * {QUANTUM} + s) AS h
  FROM (SELECT source, a, greatest(1, CAST((bytes + {BLOCK_BYTES - 1}) // {BLOCK_BYTES} AS BIGINT)) AS b FROM parts) p
  JOIN plan USING (source) WHERE j = b % p.a)
SELECT doc_id, source, CAST(n_bytes AS BIGINT) AS n_bytes, block, CAST(block // a * {QUANTUM} + s AS BIGINT) AS slot,
  CAST(block // a * {QUANTUM} + r AS BIGINT) AS release, CAST(block // a * {QUANTUM} + d AS BIGINT) AS deadline,
  block // a * {QUANTUM} + s < h AS in_mix
FROM placed JOIN plan USING (source), horizon WHERE j = block % a
"""
