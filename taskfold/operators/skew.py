"""Ordered per-key computations that survive a hot key.

A window over ``partitionBy(key)`` puts all rows of a key into one task. That is fine until one key
holds a large part of the table. Here such keys are found first, with one small aggregate, and their
rows are cut into contiguous chunks of the wanted order. Each chunk is computed on its own; what the
earlier chunks of the key contribute is carried over from a per-chunk summary.

The cut points come from a hash sample, like those of Spark's range partitioner: they decide only
how even the chunks are, never the result. Being a pure function of the rows, they stay the same when
a lost executor's work is repeated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from taskfold.session import stored

HEAVY_ROWS = 5_000_000  # a key below this is left to one task
_POINTS_PER_CHUNK = 16  # sampled to place the cut points


@dataclass(frozen=True)
class HeavyKeys:
    """Cut points of the heavy keys, known by the hash of the key columns."""

    keys: tuple[str, ...]
    order: tuple[Column, ...]
    splits: DataFrame  # _hash, _splits; about one cut point per ``min_rows`` rows of the table

    def rows_of(self, df: DataFrame) -> DataFrame:
        hashed = df.withColumn("_hash", F.xxhash64(*self.keys))
        return hashed.join(self.splits.select("_hash"), "_hash", "left_semi").drop("_hash")

    def with_chunk(self, df: DataFrame) -> DataFrame:
        """Add ``_chunk``: 0 for ordinary keys, else the number of cut points at or before the row.

        Cut points are looked up in two steps, among every n-th and then among the n after it.
        """
        here = F.struct(*_named(self.order))
        step = F.ceil(F.sqrt(F.size("_splits"))).cast("int")
        coarse = F.filter("_splits", lambda s, i: (i % F.col("_step") == 0) & (s <= here))
        fine = F.slice("_splits", (F.col("_coarse") - 1) * F.col("_step") + 1, F.col("_step"))
        return (
            df.withColumn("_hash", F.xxhash64(*self.keys))
            .join(self.splits, "_hash", "left")
            .withColumn("_step", step)
            .withColumn("_coarse", F.size(coarse))
            .withColumn(
                "_chunk",
                F.when(F.col("_splits").isNull() | (F.col("_coarse") == 0), F.lit(0)).otherwise(
                    (F.col("_coarse") - 1) * F.col("_step") + F.size(F.filter(fine, lambda s: s <= here))
                ),
            )
            .drop("_hash", "_splits", "_step", "_coarse")
        )


def find_heavy_keys(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], min_rows: int = HEAVY_ROWS
) -> HeavyKeys | None:
    """The keys with more than ``min_rows`` rows, or None (the usual case: one aggregate that counts by key).

    Needs non-null keys and an ``order`` without ties inside a key. All heavy keys are found, and each is cut into
    chunks of about ``min_rows`` rows, however many that takes. A table with no more rows than that in all has none:
    it is counted first, which moves nothing.
    """
    if df.count() <= min_rows:
        return None
    hashed = df.select(F.xxhash64(*keys).alias("_hash"))
    counted = stored(hashed.groupBy("_hash").agg(F.count("*").alias("_n")).filter(F.col("_n") > min_rows), "heavy")
    if counted.isEmpty():
        return None
    chunks = F.ceil(F.col("_n") / min_rows).cast("long")
    rates = counted.select(
        "_hash", chunks.alias("_chunks"), F.greatest(F.lit(1), F.expr(f"_n div (ceil(_n / {min_rows}) * {_POINTS_PER_CHUNK})")).alias("_every")
    )
    point = F.struct(*_named(order))
    sampled = (
        df.select(F.xxhash64(*keys).alias("_hash"), point.alias("_point"))
        .join(rates, "_hash")
        .filter(F.pmod(F.xxhash64(F.col("_point")), F.col("_every")) == 0)
        .groupBy("_hash", "_chunks")
        .agg(F.sort_array(F.collect_set("_point")).alias("_points"))
        .withColumn("_step", F.greatest(F.lit(1), F.ceil(F.size("_points") / F.col("_chunks")).cast("int")))
        .select(
            "_hash",
            F.filter("_points", lambda p, i: (i > 0) & (i % F.col("_step") == 0)).alias("_splits"),
        )
    )
    return HeavyKeys(tuple(keys), tuple(order), stored(sampled, "splits"))


def prior_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    exprs: Mapping[str, Column],
    heavy: HeavyKeys | None = None,
) -> DataFrame:
    """For each row, the maximum of each expression over the earlier rows of its key (null if none)."""
    if heavy is None:
        before = _before(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumns({n: F.max(e).over(before) for n, e in exprs.items()})

    in_chunk = _before(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    rows = heavy.with_chunk(df).withColumns({n: F.max(e).over(in_chunk) for n, e in exprs.items()})
    summary = (
        heavy.with_chunk(heavy.rows_of(df)).groupBy(*keys, "_chunk").agg(*[F.max(e).alias(n) for n, e in exprs.items()])
    )
    earlier = _before(Window.partitionBy(*keys).orderBy("_chunk"))
    carry = summary.select(*keys, "_chunk", *[F.max(n).over(earlier).alias(f"_carry_{n}") for n in exprs])
    return (
        rows.join(carry, [*keys, "_chunk"], "left")
        .withColumns({n: F.greatest(F.col(n), F.col(f"_carry_{n}")) for n in exprs})
        .drop("_chunk", *[f"_carry_{n}" for n in exprs])
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, heavy: HeavyKeys | None = None
) -> DataFrame:
    """Add ``name``: 1, 2, 3, ... within each key, in the given order."""
    if heavy is None:
        position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn(name, position.cast("long"))

    position = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    rows = heavy.with_chunk(df).withColumn(name, position.cast("long"))
    summary = heavy.with_chunk(heavy.rows_of(df)).groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    earlier = _before(Window.partitionBy(*keys).orderBy("_chunk"))
    carry = summary.select(*keys, "_chunk", F.sum("_n").over(earlier).alias("_carry"))
    return (
        rows.join(carry, [*keys, "_chunk"], "left")
        .withColumn(name, F.col(name) + F.coalesce(F.col("_carry"), F.lit(0).cast(T.LongType())))
        .drop("_chunk", "_carry")
    )


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _named(order: Sequence[Column]) -> list[Column]:
    return [c.alias(f"o{i}") for i, c in enumerate(order)]
