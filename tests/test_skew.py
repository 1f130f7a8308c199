import random

import pytest
from pyspark.sql import functions as F

from taskfold.operators.skew import find_heavy_keys, number_rows, prior_max


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(5)
    rows = [("hot", i, rnd.randrange(1000)) for i in range(3000)] + [(f"k{i % 50}", i, rnd.randrange(1000)) for i in range(500)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "k string, o long, v long").repartition(5).cache()


def order():
    return [-F.col("o") % 7, F.col("o")]


def test_only_the_hot_key_is_cut(table):
    heavy = find_heavy_keys(table, ["k"], order(), min_rows=100)
    assert heavy.splits.count() == 1
    chunked = heavy.with_chunk(table)
    sizes = {r.k: (r.n, r.m) for r in chunked.groupBy("k").agg(F.countDistinct("_chunk").alias("n"), F.max("_chunk").alias("m")).collect()}
    assert sizes.pop("hot")[0] > 20 and set(sizes.values()) == {(1, 0)}
    largest = chunked.filter("k = 'hot'").groupBy("_chunk").count().agg(F.max("count")).first()[0]
    assert largest < 300


def test_no_heavy_keys(table):
    assert find_heavy_keys(table, ["k"], order(), min_rows=5000) is None


def test_number_rows_is_the_same(table):
    heavy = find_heavy_keys(table, ["k"], order(), min_rows=100)
    plain, cut = number_rows(table, ["k"], order(), "n"), number_rows(table, ["k"], order(), "n", heavy)
    assert plain.exceptAll(cut).isEmpty() and cut.count() == 3500


def test_prior_max_is_the_same(table):
    heavy = find_heavy_keys(table, ["k"], order(), min_rows=100)
    exprs = {"a": F.when(F.col("v") < 20, F.col("v")), "b": F.col("o")}
    plain, cut = prior_max(table, ["k"], order(), exprs), prior_max(table, ["k"], order(), exprs, heavy)
    assert plain.exceptAll(cut).isEmpty() and cut.count() == 3500


def test_no_task_gets_the_whole_hot_key(table):
    """The only exchange by the bare key is that of the per-chunk summary."""
    heavy = find_heavy_keys(table, ["k"], order(), min_rows=100)
    numbered = number_rows(table, ["k"], order(), "n", heavy)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    by_key = [line for line in plan.splitlines() if "hashpartitioning(k#" in line and "_chunk" not in line]
    assert len(by_key) == 1


def test_any_number_of_heavy_keys_and_chunks(spark):
    """300 hot keys, and one that needs more than 256 chunks."""
    rows = spark.range(30_000).selectExpr("concat('k', id % 300) AS k", "id AS o", "id % 11 AS v")
    rows = rows.union(spark.range(12_000).selectExpr("'hot' AS k", "id AS o", "id % 11 AS v")).cache()
    heavy = find_heavy_keys(rows, ["k"], [F.col("o")], min_rows=40)
    assert heavy.splits.count() == 301
    sizes = heavy.with_chunk(rows).groupBy("k", "_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] < 400 and sizes.filter("k = 'hot'").count() > 256
    plain, cut = number_rows(rows, ["k"], [F.col("o")], "n"), number_rows(rows, ["k"], [F.col("o")], "n", heavy)
    assert plain.exceptAll(cut).isEmpty() and cut.count() == 42_000
