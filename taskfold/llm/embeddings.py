"""Embedding near-duplicates: an inverted multi-index over vector halves, then exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taskfold.llm.components import components
from taskfold.llm.tables import stored, table

#: Vectors that the codebooks are fitted on, at most; every vector is indexed.
SAMPLE = 20_000
MEMBER_BLOCK, QUERY_BLOCK = 2048, 4096


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centres of at most k clusters, by Lloyd's method from random points."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), False)].copy()
    for _ in range(rounds):
        nearest = squared(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        n = np.bincount(nearest, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    return (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class MultiIndex:
    """A grid of cells: a centre for each half of a unit vector. ``probes``: cells to visit for each vector."""

    left: np.ndarray
    right: np.ndarray
    probes: int = 1

    def _halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.left.shape[1]
        return squared(vectors[:, :cut], self.left), squared(vectors[:, cut:], self.right)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a, b = self._halves(vectors)
        return a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)

    def nearest_cells(self, vectors: np.ndarray, n: int | None = None) -> np.ndarray:
        """The ``n`` nearest cells of each vector in order of distance, by multi-sequence traversal.

        Cells are visited along the sorted distances of both halves. The i-th by the left and j-th by the right is
        no earlier than (i + 1) * (j + 1)-th, so only pairs with (i + 1) * (j + 1) <= n can be among the first n.
        """
        n = n or self.probes
        a, b = self._halves(vectors)
        order_a, order_b = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
        i, j = np.meshgrid(np.arange(a.shape[1]), np.arange(b.shape[1]), indexing="ij")
        front = (i + 1) * (j + 1) <= n
        i, j = i[front], j[front]
        total = np.take_along_axis(a, order_a, 1)[:, i] + np.take_along_axis(b, order_b, 1)[:, j]
        first = total.argsort(axis=1, kind="stable")[:, : min(n, total.shape[1])]
        return np.take_along_axis(order_a, i[first], 1) * len(self.right) + np.take_along_axis(order_b, j[first], 1)


def fitted(sample: np.ndarray, k: int, least_cosine: float, recall: float) -> MultiIndex:
    """Codebooks of k centres for each half, and the cells to visit for ``recall``.

    For that, partners at exactly ``least_cosine`` in random directions are made for the sample, the hardest to
    find; of these the given share lies in the visited cells. Closer partners are found more often.
    """
    cut = sample.shape[1] // 2 or 1
    index = MultiIndex(kmeans(sample[:, :cut], k), kmeans(sample[:, cut:], k if sample.shape[1] > 1 else 1))
    some = sample[np.random.default_rng(2).choice(len(sample), min(4000, len(sample)), False)]
    away = np.random.default_rng(3).normal(size=some.shape)
    away -= (away * some).sum(axis=1, keepdims=True) * some
    length = np.sqrt((away * away).sum(axis=1, keepdims=True))
    away = np.divide(away, length, out=np.zeros_like(away), where=length > 0)
    partners = index.cells(least_cosine * some + math.sqrt(1 - least_cosine**2) * away)
    all_cells = len(index.left) * len(index.right)
    place = (index.nearest_cells(some, all_cells) == partners[:, None]).argmax(axis=1)
    return MultiIndex(index.left, index.right, int(np.quantile(place, recall, method="higher")) + 1)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return units(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def _assigned(shared):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                sizes = np.array([len(v) for v in batch.column(2)])
                for size in np.unique(sizes):
                    own = batch.filter(pa.array(sizes == size))
                    index, vectors = shared.value[int(size)], _matrix(own.column(2))
                    probes = index.nearest_cells(vectors)
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns, pa.array(index.cells(vectors)),
                         pa.ListArray.from_arrays(np.arange(len(vectors) + 1, dtype=np.int32) * probes.shape[1], pa.array(probes.ravel()))],
                        ["space", "class", "vector", "copies", "cell", "probes"],
                    )

    return assign


def _block_links(least_cosine: float):
    def links(block: pa.Table) -> pa.Table:
        """Links of each query into the block's members, and for each vector the smallest one that the block's links reach."""
        role = block.column("query").to_numpy()
        ids, copies, vectors = block.column("class").to_numpy(), block.column("copies").to_numpy(), _matrix(block.column("vector"))
        q, m = np.flatnonzero(role), np.flatnonzero(~role)
        count, label_q, label_m = np.zeros(len(q), np.int64), ids[q].copy(), ids[m].copy()
        if len(m) and len(q):
            near = np.vstack([vectors[q[i : i + 512]] @ vectors[m].T >= least_cosine for i in range(0, len(q), 512)])
            near &= ids[q][:, None] != ids[m]
            count = near @ copies[m]
            far = np.iinfo(np.int64).max
            while True:
                new_q = np.minimum(label_q, np.where(near, label_m, far).min(axis=1))
                new_m = np.minimum(label_m, np.where(near, new_q[:, None], far).min(axis=0))
                if (new_q == label_q).all() and (new_m == label_m).all():
                    break
                label_q, label_m = new_q, new_m
        all_ids = np.concatenate([ids[q], ids[m]])
        reached = np.concatenate([label_q, label_m])
        n = np.concatenate([count, np.zeros(len(m), np.int64)])
        some = (reached != all_ids) | (n > 0)
        return pa.table({"class": all_ids[some], "reached": reached[some], "n": n[some]})

    return links


def near_duplicates(vectors: DataFrame, least_cosine: float = 0.98, recall: float = 0.999, k: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label are linked if their cosine, in double precision, is at least ``least_cosine``. n_links counts
    the other vectors linked to one directly; a component is what links reach, named by its smallest vec_id.

    Candidates come from an inverted multi-index. Its codebooks are fitted on at most SAMPLE vectors picked by
    hash; every vector is indexed and asks for its partners. The number of cells visited is set for the wanted
    ``recall``; what is found there is verified, so no link is wrong. k, the centres of a half, grows with the
    square root of the number of vectors, so that cells stay small; cells that are large all the same are cut into
    blocks of members and of queries.

    Equal vectors of a label are one class that is compared once. Inside a block, links are counted and contracted
    at once: a group of n vectors gives n rows, not n * n.

    Null, zero or non-finite vectors, null components, null labels and null vec_ids link with nothing; n_links is 0,
    component_id the vec_id, kept true. Vectors of other lengths are never linked. Rows that share a vec_id are one
    vector. Without rows the result is empty.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    good = F.expr(
        "vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"
        " AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vector, x -> x <> 0)"
    )
    rows = rows.withColumn("vector", F.expr("transform(vector, x -> x + 0.0D)")).withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("space", F.concat_ws(":", F.col("label").cast("string"), F.size("vector").cast("string")))
    usable = rows.filter("good").select("space", "vector", "vec_id").distinct()
    classes = stored(usable.groupBy("space", "vector").agg(F.min("vec_id").alias("class"), F.count("*").alias("copies")), "classes")
    total = classes.count()
    k = k or max(1, min(256, round(math.sqrt(total / 200))))
    picked = classes.orderBy(F.xxhash64("class", "space")).limit(SAMPLE).select("vector").collect()
    by_size: dict[int, list] = {}
    for r in picked:
        by_size.setdefault(len(r["vector"]), []).append(r["vector"])
    for r in classes.select(F.size("vector").alias("n")).distinct().collect():  # lengths that the sample missed
        by_size.setdefault(r["n"], [[1.0] * r["n"]])
    shared = spark.sparkContext.broadcast({n: fitted(units(np.array(v)), k, least_cosine, recall) for n, v in by_size.items()})
    assigned = classes.select("space", "class", "vector", "copies").mapInArrow(
        _assigned(shared), "space string, class long, vector array<double>, copies long, cell long, probes array<long>"
    )
    assigned = stored(assigned, "assigned")
    members = assigned.select("space", "cell", "class", "copies", "vector")
    queries = assigned.select("space", F.explode("probes").alias("cell"), "class", "copies", "vector")
    sizes = members.groupBy("space", "cell").agg(F.ceil(F.count("*") / MEMBER_BLOCK).alias("member_blocks"))
    asks = queries.groupBy("space", "cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("query_blocks"))
    blocks = stored(sizes.join(asks, ["space", "cell"]), "blocks")
    own = F.xxhash64("class")
    dealt = members.join(blocks, ["space", "cell"]).select(
        "space", "cell", F.pmod(own, "member_blocks").alias("mb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)).alias("qb"),
        "class", "copies", "vector", F.lit(False).alias("query"),
    ).union(queries.join(blocks, ["space", "cell"]).select(
        "space", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("member_blocks") - 1)).alias("mb"), F.pmod(own, "query_blocks").alias("qb"),
        "class", "copies", "vector", F.lit(True).alias("query"),
    ))
    found = stored(
        dealt.groupBy("space", "cell", "mb", "qb").applyInArrow(_block_links(least_cosine), "class long, reached long, n long"), "found"
    )
    counts = found.groupBy("class").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("class").alias("a"), F.col("reached").alias("b")))
    known = (
        classes.select("space", "vector", "class", "copies")
        .join(counts, "class", "left")
        .join(joined, F.col("class") == F.col("node"), "left")
        .select(
            "space",
            "vector",
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("component", "class").alias("component_id"),
        )
    )
    linked = rows.filter("good").join(known, ["space", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embedding_near_dedup(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Every pair of a label; components by the smallest vec_id that is reached.
OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, CAST(min(root) AS BIGINT) AS component_id, min(root) = vec_id AS kept
FROM embeddings JOIN r ON id = vec_id GROUP BY vec_id
"""
