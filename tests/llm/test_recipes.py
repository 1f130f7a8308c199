"""Exact duplicates against a plain grouping of the normalised texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from taskfold.llm import recipes as rc


def brute(rows):
    norm = [(i, re.sub("[ \t-\r]+", " ", t or "")) for i, t in rows]
    groups = {}
    for n, (i, t) in enumerate(norm):
        groups.setdefault(t, []).append((i is None, i, n))
    out = []
    for n, (i, t) in enumerate(norm):
        own = groups[t]
        first = min(own, key=lambda x: (x[0], x[1] or 0, x[2]))
        out.append((i, first[1], len(own), first[2] == n, hashlib.sha256(t.encode()).hexdigest()))
    return out


def rows():
    rng = random.Random(1)
    some = lambda n: " ".join(rng.choice(["ab", "né", "δέλτα", "x%d" % rng.randrange(99)]) for _ in range(n))
    long_ = some(40_000)
    texts = [None, "", "  ", " ", "a", "a ", " a", "\ta", "a\x0b\x0cb", "a b", "a  b", "a b", "z" * 300_000, "z" * 300_000, "z" * 300_001]
    texts += [long_, long_.replace(" ", "\n", 7), long_[:-1] + "!", "!" + long_[1:], long_[:100_000] + long_]
    texts += [some(rng.randrange(400)) for _ in range(60)] + ["copy of one"] * 120
    texts += [t + rng.choice(["", "", "!"]) for t in texts[20:60]]
    out = list(enumerate(texts))
    rng.shuffle(out)
    return out + [(None, "a b"), (None, None), (None, None), (None, "alone"), (7, texts[7]), (30, texts[30]), (30, "other")]


def as_table(spark, data):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, `row` int, `ids.a b` string")


@pytest.mark.parametrize("bits,digest_bits", [(10, 64), (5, 64), (5, 7), (4, 3)])
def test_against_brute_force(spark, bits, digest_bits):
    data = rows()
    found = rc.exact_duplicates(as_table(spark, data), bits, digest_bits)
    got = [tuple(r)[:5] for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(data)))


def test_identifiers_stand_for_one_chunk_each(spark):
    data = rows()
    own = rc.chunk_table(as_table(spark, data), 5, 6)
    assert own.count() == own.select("bytes").distinct().count() == own.select("digest", "number").distinct().count()
    assert own.filter("number > 0").count() > 100
    read = rc.recipes(as_table(spark, data), 5, 6).select(
        "row", "n_bytes", F.posexplode("recipe.ids").alias("pos", "digest"), F.map_from_entries("recipe.numbers").alias("m")
    )
    read = read.select("row", "pos", "n_bytes", "digest", F.coalesce(F.col("m")[F.col("pos")], F.lit(0)).alias("number"))
    sizes = read.join(own, ["digest", "number"]).groupBy("row").agg(F.sum(F.length("bytes")).alias("n"), F.max("n_bytes").alias("all"))
    assert sizes.filter("n <> all").isEmpty() and sizes.count() > 100


def test_hot_groups_take_no_shuffle_of_their_rows(spark):
    data = [(i, "same") for i in range(3000)] + [(i, f"own {i // 2}") for i in range(3000, 3300)]
    for share in (0.001, 0.5, 1.0):
        got = rc.exact_duplicates(spark.createDataFrame(data, "doc_id long, text string"), hot_share=share)
        assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(brute(data))


def test_query_and_empty_table(spark, tmp_path):
    data = [d for d in rows() if d[0] is not None]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in rc.op12_exact_dedup(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(data)))
    assert rc.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
