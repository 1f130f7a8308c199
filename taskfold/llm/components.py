"""Connected components of a large graph, by stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taskfold.llm.tables import dropped, stored

#: Links that one task contracts by itself.
TASK_LINKS = 500_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of the links of one task, with the smallest node it reaches by them."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = above[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    moved = [(x, r) for x in above if (r := top(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in moved], pa.int64()) for i in (0, 1)], ["a", "b"])


def _min_neighbour(arcs: DataFrame) -> DataFrame:
    """For each u the smallest node among itself and its neighbours."""
    return arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node that the node knows."""
    arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    arcs = arcs.union(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return arcs.join(_min_neighbour(arcs), "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of these."""
    arcs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = arcs.groupBy("u").agg(F.min("v").alias("m"))
    moved = arcs.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b")


def components(edges: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """``a``, ``b`` (links) -> ``node``, ``component`` (its smallest node), for every node with a smaller one.

    First each task contracts its share of the links to stars. Where there was more than one share, large and
    small stars take turns until every edge leads to the smallest node of its component; the rounds grow with
    the logarithm of the nodes. A node's neighbours are never gathered: its smallest one comes from an
    aggregate and is joined back, a join that adaptive execution splits where a node is hot. Null ends and
    loops are no links.
    """
    links = stored(edges.filter("a <> b").select("a", "b"), "links")
    shares = max(1, -(-links.count() // task_links))
    now = stored(links.repartition(shares).mapInArrow(_contracted, "a long, b long"), "edges")
    dropped(links)
    before = None
    while shares > 1:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        step = stored(_small_star(_large_star(now)).distinct(), "edges")
        dropped(now)
        now = step
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
