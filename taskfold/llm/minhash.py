"""Near-duplicate documents: one-permutation MinHash, banded buckets, stars of candidates, exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from taskfold.llm import bytetext as bt
from taskfold.llm.components import components
from taskfold.llm.tables import dropped, stored, table

U = np.uint64
_EMPTY = U(2**64 - 1)


def one_permutation(values: np.ndarray, owner: np.ndarray, n: int, bins: int) -> np.ndarray:
    """MinHash signatures of n sets from one hash per element: the smallest hash in each of ``bins`` ranges.

    An empty bin takes the value of another one. Which one depends on the bin and the attempt only (optimal
    densification), so equal sets fill alike and the chance to agree stays the Jaccard similarity.
    """
    out = np.full((n, bins), _EMPTY)
    slot = ((values >> U(32)) * U(bins) >> U(32)).astype(np.int64)
    at = owner * bins + slot
    order = np.lexsort((values, at))
    at = at[order]
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    out.ravel()[at[first]] = values[order][first]
    full = out != _EMPTY
    known = full.sum(axis=1)
    single = np.flatnonzero(known == 1)
    out[single] = out[single].min(axis=1)[:, None]
    rows, holes = np.nonzero(~full & (known > 1)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        source = (bt.mix(holes.astype(U) * U(0x9FB21C651E98DF25) + U(attempt)) % U(bins)).astype(np.int64)
        hit = full[rows, source]
        out[rows[hit], holes[hit]] = out[rows[hit], source[hit]]
        rows, holes = rows[~hit], holes[~hit]
    return out


def band_buckets(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One bucket number per band of ``rows`` neighbouring bins."""
    n, bins = signatures.shape
    parts = signatures.reshape(n, bins // rows, rows)
    h = np.broadcast_to(np.arange(bins // rows, dtype=U), (n, bins // rows)).copy()
    for i in range(rows):
        h = bt.mix(h * U(0x9E3779B97F4A7C15) + parts[:, :, i])
    return h


def _sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, end, data, offsets in bt.slices(column):
        hashes, owner, _, _ = bt.hashed_words(data, offsets, bt.BY_SPACE)
        yield first, end, *bt.distinct(*bt.shingles(hashes, owner, end - first, k))


def sketched(docs: DataFrame, k: int = 5, bands: int = 32, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (``d0``, ``d1``) and the buckets of its bands."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, values, owner in _sets_of(batch.column(1), k):
                n = end - first
                counts = np.bincount(owner, minlength=n)
                start = np.concatenate([[0], np.cumsum(counts)])
                sums = [np.concatenate([[U(0)], np.cumsum(v, dtype=U)]) for v in (values, bt.mix(values * U(3)))]
                some = np.flatnonzero(counts)
                buckets = np.zeros((n, bands), U)
                if len(some):
                    dense = np.cumsum(counts > 0) - 1
                    buckets[some] = band_buckets(one_permutation(values, dense[owner], len(some), bands * rows), rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first:end],
                        pa.array(counts.astype(np.int64)),
                        *(pa.array((s[start[1:]] - s[start[:-1]]).view(np.int64)) for s in sums),
                        bt.list_array(buckets[some].ravel().view(np.int64), np.where(counts > 0, bands, 0)),
                    ],
                    ["doc_id", "n_shingles", "d0", "d1", "buckets"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        sketch, "doc_id long, n_shingles long, d0 long, d1 long, buckets array<long>"
    )


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and the whole set of its shingles."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, values, owner in _sets_of(batch.column(1), k):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:end], bt.list_array(values.view(np.int64), np.bincount(owner, minlength=end - first))],
                    ["doc_id", "shingles"],
                )

    return docs.select("doc_id", "text").mapInArrow(hashed, "doc_id long, shingles array<long>")


def _close_enough(least_percent: int):
    common = F.size(F.array_intersect("x.shingles", "y.shingles"))
    return common * 100 >= (F.size("x.shingles") + F.size("y.shingles") - common) * least_percent


def near_duplicates(docs: DataFrame, k: int = 5, least_percent: int = 80, bands: int = 32, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * |A and B| >= least_percent * |A or B| for their sets of k-word shingles;
    a component is what links reach, named by its smallest doc_id. Candidates come from MinHash bands (at the
    default 80 percent a linked pair shares no bucket with a chance of 0.74**32, under 1e-4); links are
    confirmed on the full sets.

    Equal sets are one class, whose smallest doc_id stands for all. In a bucket, one document is the centre of
    a star: it is compared with all others. It is the one that shares its buckets with most others, as the original of a
    group of changed copies does, to which more of them are close than to each other. Of the members that the star has not joined to
    one component, those whose elements the others don't have are told apart; the rest of a bucket is compared in all pairs, a
    large one in blocks, by products of incidence matrices. Only of a bucket with more than LARGE_BUCKET members left
    further centres come first, eight times as many each round, until it is small or its pairs have all been compared. So
    a group of n copies costs about n comparisons, and no pair that matters is left out.

    Null text and text without words: empty set, linked with nothing. Rows with a null doc_id: linked with
    nothing, component_id null, kept. Rows that share a doc_id are one document; if their texts differ, a text
    that a smaller document has speaks for all. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stored(sketched(docs, k, bands, rows), "sketches")
    usable = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    same = (
        usable.select("doc_id", "d0", "d1")
        .join(classes.filter("copies > 1").select("d0", "d1", "rep"), ["d0", "d1"])
        .filter("doc_id <> rep")
        .select("doc_id", "rep")
    )
    same = stored(same, "copies")
    alone = usable.join(same.select("doc_id").distinct(), "doc_id", "left_anti")
    members = alone.select(F.explode("buckets").alias("bucket"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"))
    open_ = stored(_in_open_buckets(members.withColumn("comp", F.col("rep"))), "open")
    crowd = stored(open_.join(open_.groupBy("rep").agg(F.sum("size").alias("weight")), "rep"), "crowd")
    dropped(open_)
    wanted = crowd.select(F.col("rep").alias("doc_id")).distinct()
    whole = stored(full_sets(docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi"), k), "sets")
    out = sets.join(same.groupBy("doc_id").agg(F.min("rep").alias("rep")), "doc_id", "left").withColumn("component_id", F.coalesce("rep", "doc_id"))
    for joined in _star_rounds(crowd, whole, least_percent):
        out = out.join(joined, F.col("component_id") == F.col("node"), "left").select(
            "doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id")
        )
    return out.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


#: Members of a bucket that are all compared in pairs of columns, and in blocks of numpy, in the second round; of the latter
#: four times as many in each later round.
SMALL_BUCKET, LARGE_BUCKET = 32, 4096
#: Members and elements of a block, about; columns of a matrix.
BLOCK_MEMBERS, BLOCK_ELEMENTS, COLUMNS = 512, 1 << 18, 1 << 11


def _star_rounds(crowd: DataFrame, whole: DataFrame, least_percent: int) -> list[DataFrame]:
    """Which components each round joins (node, component), where a round's nodes are the components before it.

    ``crowd``: bucket, rep, n (size of its set), weight (members of all its buckets), size (of the bucket), elements (of all
    its sets), comp (component of rep so far).
    """
    rounds, turn, shared = [], 0, None
    while True:
        large = F.col("size") > (LARGE_BUCKET * 4 ** (turn - 1) if turn else 0)
        best = F.min(F.struct((-F.col("weight")).alias("weight"), "rep"))
        slot = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(8**turn))
        picked = crowd.filter(large).groupBy("bucket", slot.alias("slot")).agg(best.alias("best")).select("bucket", F.col("best.rep").alias("centre"))
        if turn:
            found = _linked_by_pairs(crowd, shared, least_percent).union(_linked_in_blocks(crowd, picked, large, shared, least_percent))
        else:
            found = _linked_to_centres(crowd, picked, whole, least_percent)
        joined = components(found)
        rounds.append(joined)
        dropped(shared)
        if turn and crowd.filter(large).isEmpty():
            return rounds
        rest = (
            crowd.filter(large)
            .join(picked.withColumnRenamed("centre", "rep"), ["bucket", "rep"], "left_anti")
            .join(joined, F.col("comp") == F.col("node"), "left")
            .select("bucket", "rep", "n", "weight", F.coalesce("component", "comp").alias("comp"))
        )
        rest = stored(_in_open_buckets(rest), "rest")
        dropped(crowd)
        if rest.isEmpty():
            return rounds
        shared, turn = stored(_that_may_link(rest, whole, least_percent), "shared"), turn + 1
        crowd = stored(_in_open_buckets(rest.join(shared.select("rep"), "rep", "left_semi")), "crowd")
        dropped(rest)


def _in_open_buckets(crowd: DataFrame) -> DataFrame:
    """The rows of buckets with members of two components, with the number of members and of their elements."""
    still = crowd.groupBy("bucket").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"), F.sum("n").alias("elements")
    )
    return crowd.drop("size", "elements").join(still.filter("low < high").select("bucket", "size", "elements"), "bucket")


def _linked_to_centres(crowd: DataFrame, picked: DataFrame, whole: DataFrame, least_percent: int) -> DataFrame:
    """a, b: components of members close to the centre of a bucket."""
    centres = crowd.select("bucket", F.col("rep").alias("centre"), F.col("comp").alias("ccomp"), F.col("n").alias("cn"))
    centres = picked.join(centres, ["bucket", "centre"])
    most = F.least("n", "cn")  # more elements can't be common
    possible = most * 100 >= (F.col("n") + F.col("cn") - most) * least_percent
    pairs = (
        crowd.join(centres, "bucket")
        .filter((F.col("comp") != F.col("ccomp")) & possible)
        .select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"),
                F.least("comp", "ccomp").alias("ca"), F.greatest("comp", "ccomp").alias("cb"))
        .distinct()
    )
    return (
        pairs.join(whole.alias("x"), F.col("a") == F.col("x.doc_id"))
        .join(whole.alias("y"), F.col("b") == F.col("y.doc_id"))
        .filter(_close_enough(least_percent))
        .select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    )


def _that_may_link(crowd: DataFrame, whole: DataFrame, least_percent: int) -> DataFrame:
    """rep, n, comp and ``shared`` of the members that may have a link to another component.

    An element that no open member of another component has is never common to a linked pair. ``shared`` are the
    others, so it gives the exact number of common elements of two members of different components. A member with
    too few of them can be linked with none.
    """
    members = crowd.select("rep", "n", "comp").distinct()
    elements = members.join(whole.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "n", "comp", F.explode("shingles").alias("e"))
    spread = elements.groupBy("e").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    lists = elements.join(spread.select("e"), "e").groupBy("rep", "n", "comp").agg(F.collect_list("e").alias("shared"))
    return lists.filter(F.size("shared") * 100 >= F.col("n") * least_percent)


def _linked_by_pairs(crowd: DataFrame, shared: DataFrame, least_percent: int) -> DataFrame:
    """a, b: components of close members of small buckets."""
    small = crowd.filter(F.col("size") <= SMALL_BUCKET).select("bucket", "rep", "n", "comp")
    least, most = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    pairs = (
        small.alias("x")
        .join(small.alias("y"), "bucket")
        .filter((F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp")) & (least * 100 >= most * least_percent))
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .distinct()
    )
    common = F.size(F.array_intersect("x.shared", "y.shared"))
    return (
        pairs.join(shared.alias("x"), F.col("a") == F.col("x.rep"))
        .join(shared.alias("y"), F.col("b") == F.col("y.rep"))
        .filter(common * 100 >= (F.col("x.n") + F.col("y.n") - common) * least_percent)
        .select(F.least("x.comp", "y.comp").alias("a"), F.greatest("x.comp", "y.comp").alias("b"))
    )


def _linked_in_blocks(crowd: DataFrame, picked: DataFrame, large: Column, shared: DataFrame, least_percent: int) -> DataFrame:
    """a, b: components of close members of all other buckets, of whose members a large one compares its centres alone.

    A bucket is cut into blocks of bounded size. Each two blocks (or a block and itself) meet in a group of their own.
    """
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_MEMBERS), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("int")
    cut = crowd.filter(F.col("size") > SMALL_BUCKET).select("bucket", "rep", large.alias("large"), blocks.alias("blocks"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = "transform(sequence(0, blocks - 1), i -> struct(least(i, own) AS p, greatest(i, own) AS q, own AS at))"
    within = cut.filter("NOT large").select("bucket", "rep", F.expr(f"inline({every})"))
    # the centres of a large bucket are dealt to as many blocks as they need, numbered after those of its members
    beside = picked.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("more"))
    cut = cut.filter("large").join(beside, "bucket")
    to_centres = "transform(sequence(0, more - 1), i -> struct(own AS p, blocks + i AS q, own AS at))"
    ahead = "blocks + cast(pmod(xxhash64(rep), more) AS int)"
    to_members = f"transform(sequence(0, blocks - 1), i -> struct(i AS p, {ahead} AS q, {ahead} AS at))"
    centres = cut.join(picked.withColumnRenamed("centre", "rep"), ["bucket", "rep"], "left_semi")
    rows = within.union(cut.select("bucket", "rep", F.expr(f"inline({to_centres})"))).union(centres.select("bucket", "rep", F.expr(f"inline({to_members})")))

    def compare(rows: pa.Table) -> pa.Table:
        return _close_in_block(rows, least_percent)

    return rows.join(shared, "rep").groupBy("bucket", "p", "q").applyInArrow(compare, "a long, b long")


def _close_in_block(rows: pa.Table, least_percent: int) -> pa.Table:
    """The components (a, b) of close members of block p and block q, by products of their incidence matrices."""
    at, n, comp = (rows.column(c).to_numpy() for c in ("at", "n", "comp"))
    left, right = (np.flatnonzero(at == rows.column(c)[0].as_py()) for c in ("p", "q"))
    lists = rows.column("shared").combine_chunks()
    owner = np.repeat(np.arange(len(at)), lists.value_lengths().to_numpy())
    _, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [first, first + COLUMNS]))
        has = np.zeros((len(at), COLUMNS), np.float32)
        has[owner[part], column[part] - first] = 1
        common += has[left] @ has[right].T
    common = common.astype(np.int64)
    close = common * 100 >= (n[left][:, None] + n[right] - common) * least_percent
    x, y = np.nonzero(close & (comp[left][:, None] != comp[right]))
    x, y = comp[left[x]], comp[right[y]]
    links = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
    return pa.table({"a": links[:, 0], "b": links[:, 1]})


def op6_minhash_near_dedup(spark, sf_dir) -> DataFrame:
    """Three-word shingles, 85 percent."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, least_percent=85)
