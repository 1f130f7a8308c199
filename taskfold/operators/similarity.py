"""Ranking a filtered subset by closeness to a query vector, or to each of a table of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from taskfold.session import stored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays of equal length; null when one of them is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def nearest(subset: DataFrame, vector: Sequence[float], k: int, column: str = "embedding", key: str = "id") -> DataFrame:
    """The k rows of an already filtered subset closest to ``vector`` (ties by key)."""
    wanted = F.array(*[F.lit(float(v)) for v in vector])
    return (
        subset.withColumn("similarity", cosine(F.col(column), wanted))
        .filter(F.col("similarity").isNotNull())
        .orderBy(F.col("similarity").desc(), key)
        .limit(k)
    )


#: Vectors that the cells are fitted on, at most; cells, at most; items and queries that one task compares at a time.
SAMPLE_ROWS, MAX_CELLS, BLOCK_ROWS = 20_000, 4_096, 4_096


@dataclass(frozen=True)
class VectorIndex:
    """Items by cell: the cell of the nearest centre, and what is left of the unit vector in a byte a number.

    ``codes``: id, facet, cell, block, code, scale, err (length of what the code leaves out).
    """

    items: DataFrame
    codes: DataFrame
    centres: np.ndarray


def _units():  # closures, so that workers need not import this package
    def unit(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, unit vectors) of the vectors with a direction; others, also of another length, are left out."""
        rows, out = [], []
        for i, v in enumerate(column.to_pylist()):
            if v is None or len(v) != size or None in v:
                continue
            x = np.array(v, np.float64)
            length = np.sqrt(x @ x)
            if np.isfinite(length) and length > 0:
                rows.append(i)
                out.append(x / length)
        return np.array(rows, np.int64), np.array(out).reshape(-1, size)

    return unit


def _fitted_centres(vectors: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    centres = vectors[np.linspace(0, len(vectors) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.argmax(vectors @ centres.T, axis=1)
        for c in range(cells):
            own = vectors[nearest == c]
            if len(own):
                mean = own.mean(axis=0)
                centres[c] = mean / max(np.sqrt(mean @ mean), 1e-12)
    return centres


def index_vectors(
    items: DataFrame, key: str = "id", column: str = "embedding", facet: str | None = None,
    cells: int | None = None, block_rows: int = BLOCK_ROWS,
) -> VectorIndex:
    """An index of a table of vectors (keys are unique numbers), with an optional facet to filter by.

    The centres are fitted on a bounded sample, on the driver; every vector with a direction is indexed. A cell
    is cut into blocks of about ``block_rows`` items, so a cell that holds a third of all is many tasks.
    """
    of = F.col(facet).cast("string") if facet else F.lit(None).cast("string")
    slim = items.select(F.col(key).cast("long").alias("id"), of.alias("facet"), F.col(column).cast("array<double>").alias("vector"))
    slim = slim.filter("id IS NOT NULL AND vector IS NOT NULL")
    picked = slim.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vector").collect()
    size = max((len(r[0]) for r in picked), default=1)
    _, sample = _units()(pa.array([r[0] for r in picked], pa.list_(pa.float64())), size)
    if not len(sample):
        sample = np.ones((1, size)) / np.sqrt(size)
    centres = _fitted_centres(sample, min(cells or int(np.sqrt(slim.count())) or 1, MAX_CELLS, len(sample)))
    coder = _coder(centres)
    coded = stored(slim.mapInArrow(coder, "id long, facet string, cell int, code binary, scale double, err double"), "codes")
    sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))  # at most MAX_CELLS rows
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    return VectorIndex(slim, coded.join(F.broadcast(sizes), "cell").select("*", block), centres)


def _coder(centres: np.ndarray):
    unit = _units()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = unit(batch.column(2), centres.shape[1])
            cell = np.argmax(x @ centres.T, axis=1) if len(x) else np.empty(0, np.int64)
            rest = x - centres[cell]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127 if len(x) else np.empty(0)
            codes = np.rint(rest / scale[:, None]).astype(np.int8)
            err = np.sqrt(((rest - codes * scale[:, None]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(cell.astype(np.int32)),
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(err)],
                ["id", "facet", "cell", "code", "scale", "err"],
            )

    return code


def nearest_many(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, rank, id, similarity) of the ``k`` items closest to each query (query_id, embedding, facet), ties by id.

    A query with a facet sees the items of that facet alone. It visits the ``probes`` nearest cells that hold such
    items (default: all of them), where codes tell each similarity up to the length that a code leaves out. What may be
    among the best by these bounds is compared exactly. So all is exact but for cells that weren't visited.

    Queries and items meet in blocks: a task compares some thousands of each at a time, and sends on what could be
    among a query's best. Queries without a direction find nothing.
    """
    centres, size, unit = index.centres, index.centres.shape[1], _units()
    asked = queries.select(
        F.col("query_id").cast("long").alias("query_id"), F.col("facet").cast("string").alias("facet"), F.col("embedding").cast("array<double>").alias("vector")
    )

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = unit(batch.column(2), size)
            order = np.argsort(-(x @ centres.T), axis=1, kind="stable").astype(np.int32)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(order), pa.list_(pa.int32()))],
                ["query_id", "facet", "vector", "cells"],
            )

    ordered = stored(asked.mapInArrow(near, "query_id long, facet string, vector array<double>, cells array<int>"), "queries")
    total = ordered.count()
    slices = max(1, -(-total // BLOCK_ROWS))
    held = index.codes.select("cell", "facet").distinct()
    steps = ordered.select("query_id", "facet", F.posexplode("cells").alias("step", "cell"))
    with_facet = steps.filter("facet IS NOT NULL").join(held, ["cell", "facet"])
    without = steps.filter("facet IS NULL").join(held.select("cell").distinct(), "cell")
    visits = with_facet.select("query_id", "step", "cell").unionByName(without.select("query_id", "step", "cell"))
    if probes is not None:
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("step"))
        visits = visits.withColumn("nth", nth).filter(F.col("nth") <= probes)
    blocks = index.codes.select("cell", "block").distinct()
    slice_ = F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int").alias("slice")
    left = visits.join(blocks, "cell").join(ordered.select("query_id", "facet", "vector"), "query_id").select("cell", "block", slice_, "query_id", "facet", "vector")
    right = index.codes.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    group = ["cell", "block", "slice"]

    def compare(key, asked, items) -> pd.DataFrame:
        columns = ["query_id", "id", "low", "high"]
        if not len(asked) or not len(items):
            return pd.DataFrame({c: [] for c in columns})
        codes = np.frombuffer(b"".join(items["code"]), np.int8).reshape(len(items), -1)
        x = centres[int(items["cell"].iat[0])] + codes * items["scale"].to_numpy()[:, None]
        err, ids, facets = items["err"].to_numpy() + 1e-9, items["id"].to_numpy(), items["facet"].to_numpy()
        out = []
        for first in range(0, len(asked), 256):
            part = asked.iloc[first : first + 256]
            about = np.stack(part["vector"]) @ x.T
            for q, wanted, row in zip(part["query_id"], part["facet"], about):
                own = np.arange(len(ids)) if wanted is None else np.flatnonzero(facets == wanted)
                low, high = row[own] - err[own], row[own] + err[own]
                keep = high >= np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else np.ones(len(low), bool)
                out.append((np.full(keep.sum(), q), ids[own[keep]], low[keep], high[keep]))
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(columns)})

    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(compare, "query_id long, id long, low double, high double")
    found = stored(found, "candidates")
    kth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low"), "id"))
    least = found.withColumn("n", kth).filter(F.col("n") == k).select("query_id", F.col("low").alias("least"))
    maybe = found.join(least, "query_id", "left").filter("least IS NULL OR high >= least").select("query_id", "id")
    exact = maybe.join(index.items.select("id", F.col("vector").alias("_item")), "id").join(asked.select("query_id", F.col("vector").alias("_query")), "query_id")
    ranked = exact.select("query_id", "id", cosine(F.col("_item"), F.col("_query")).alias("similarity"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return ranked.withColumn("rank", place.cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")
