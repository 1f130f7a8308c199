"""Ranked search against scores of all pairs, and the bounds it rests on."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from taskfold.llm import ranked as rk

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(docs, items, k=20):
    own = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    own = [d for d in own if d[2]]
    big_n, big_l = len(own), sum(d[2] for d in own)
    df = Counter(t for d in own for t in d[1])
    out = []
    for item_id, text in items:
        scores = []
        for i, tf, n in own:
            m = 100 - 25 + (25 * n * big_n) // big_l
            score = 0
            for t in words(text):
                w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                if tf[t]:
                    score += w * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(scores)[:k], 1):
            out.append((item_id, rank, None if null else i, -score))
    return out


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    common = ["the", "of", "né", "Und", "ΔΕΛΤΑ", "to"]
    some = lambda k: " ".join(rng.choice(common) if rng.random() < 0.5 else "w%d" % int(rng.paretovariate(0.4) % 900) for _ in range(k))
    docs = [(i, some(rng.randrange(1, 120))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(60)]
    docs += [(5000, None), (5001, ""), (5002, "... --"), (5003, "the " * 30_000 + "w5"), (None, docs[3][1]), (None, "w1 w2 w3"), (9, docs[9][1])]
    rng.shuffle(docs)
    items = [(i, some(rng.randrange(1, 40))) for i in range(25)] + [(90, None), (91, ""), (92, "zzz qqq"), (None, "w1 w2 the"), (93, "The the THE w7 w7")]
    return docs, items + [(93, "of of")]


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, `score of.all` int").repartition(5),
        spark.createDataFrame(items, "item_id long, text string"),
    )


@pytest.mark.parametrize("k,item_bytes,block_docs", [(20, 1 << 20, 64), (3, 600, 4096)])
def test_against_brute_force(spark, k, item_bytes, block_docs):
    docs, items = corpus()
    found = rk.ranked(*tables(spark, docs, items), k, item_bytes, block_docs)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, brute(docs, items, k)))


def test_pair_bounds_hold_and_are_tighter(spark):
    docs, items = corpus(seed=2)
    index = rk.build_index(tables(spark, docs, items)[0], items, 5, 100)
    tighter = skipped = 0
    for row in index.blocks.collect():
        block = rk.Block(row.asDict())
        for query in index.queries:
            bounds = block.bounds(query)
            sums = np.zeros(len(block.docs), np.int64)
            alone = 0
            for i, (t, r) in enumerate(zip(query.terms, query.repeats)):
                if t in block.lists:
                    span, highest = block.lists[t]
                    sums[block.at[span]] += r * block.impacts[span]
                    alone += r * highest
                assert sums.max() <= bounds[i + 1] <= alone
                tighter += bounds[i + 1] < alone
            least = int(sums.max())
            at, scores = block.found(query, max(1, least))
            assert sorted(at.tolist()) == np.flatnonzero((sums >= max(1, least))).tolist() and (scores == sums[at]).all()
            skipped += len(block.found(query, least + 1)[0]) == 0
            assert not block.sum.any()
    assert tighter > 1000 and skipped


def test_equal_hashes_are_compared_byte_by_byte():
    vocabulary = rk.Vocabulary([b"abc", b"abd"])
    data = np.frombuffer(b"abc abx", np.uint8)
    hashes = np.repeat(vocabulary.hashes[:1], 2)  # as if both words had the hash of one term
    word, term = vocabulary.find(data, hashes, np.array([0, 4]), np.array([3, 7]))
    assert [vocabulary.terms[t] for t in term] == ([b"abc"] if vocabulary.order[0] == 0 else [])
    assert word.tolist() == ([0] if vocabulary.order[0] == 0 else [])


def test_query_and_empty_tables(spark, tmp_path):
    docs, items = corpus(200)
    a, b = tables(spark, docs, items)
    a.write.parquet(f"{tmp_path}/documents.parquet")
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in rk.op11_ranked_search(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(docs, items)))
    assert rk.ranked(a.limit(0), b).collect() == [] and rk.ranked(a, b.limit(0)).collect() == []
