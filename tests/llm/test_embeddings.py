"""Embedding near-duplicates against all pairs."""

import math

import numpy as np
import pytest

from taskfold.llm import embeddings as em

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, cell int"


def brute(rows, least=0.98):
    """Rows (vec_id, vector, label); ids unique where not null."""
    def usable(r):
        return r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    good = [r for r in rows if usable(r)]
    root, n = {r[0]: r[0] for r in good}, dict.fromkeys((r[0] for r in good), 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    unit = {r[0]: np.array(r[1]) / np.linalg.norm(np.array(r[1])) for r in good}
    for k, a in enumerate(good):
        for b in good[:k]:
            if a[2] == b[2] and len(a[1]) == len(b[1]) and unit[a[0]] @ unit[b[0]] >= least:
                n[a[0]] += 1
                n[b[0]] += 1
                low, high = sorted((find(a[0]), find(b[0])))
                root[high] = low
    return sorted(((r[0], n.get(r[0], 0), find(r[0]) if r[0] in root else r[0], r[0] not in root or find(r[0]) == r[0]) for r in rows), key=repr)


def rows(n=900, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 32))
    for i in range(0, n, 3):
        j = rng.integers(0, n)
        base[i] = base[j] + rng.normal(size=32) * rng.choice([0, 0.05, 0.1, 0.15, 0.2])
    base[100:180] = base[99] + rng.normal(size=(80, 32)) * 0.12
    base[200:240] = base[199]
    vectors = base.astype(np.float32).astype(float)
    out = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(vectors)]
    out += [(n + 1, None, 1), (n + 2, [0.0] * 32, 1), (n + 3, [None] + [1.0] * 31, 1), (n + 4, [math.nan] * 32, 1), (n + 5, [math.inf] * 32, 1),
            (n + 6, out[0][1], None), (None, out[0][1], 0), (n + 7, [], 0), (n + 8, [1.0], 0), (n + 9, [2.0], 0), (n + 10, [-0.0, 1.0], 0), (n + 11, [0.0, 1.0], 0)]
    return out


@pytest.mark.parametrize("blocks", [(2048, 4096), (20, 30)])
def test_against_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(em, "MEMBER_BLOCK", blocks[0])
    monkeypatch.setattr(em, "QUERY_BLOCK", blocks[1])
    data = rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA)
    got = sorted((tuple(r) for r in em.near_duplicates(df, recall=1.0, k=5).collect()), key=repr)
    want = brute(data)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found >= 0.995 * there and len(got) == len(want)
    assert all(a[0] == b[0] and a[1] <= b[1] for a, b in zip(got, want))
    assert sum(a == b for a, b in zip(got, want)) >= 0.98 * len(want)


def test_recall_of_the_index():
    rng = np.random.default_rng(4)
    sample = em.units(rng.normal(size=(3000, 64)))
    index = em.fitted(sample, 16, 0.98, 0.99)
    fresh = em.units(rng.normal(size=(2000, 64)))
    partner = em.units(fresh + 0.19 * em.units(rng.normal(size=(2000, 64))))
    cos = (fresh * partner).sum(axis=1)
    hit = (index.nearest_cells(fresh) == index.cells(partner)[:, None]).any(axis=1)
    assert hit[cos >= 0.98].mean() >= 0.97 and index.probes < 256 / 2


def test_traversal_is_in_order():
    rng = np.random.default_rng(5)
    index = em.MultiIndex(rng.normal(size=(6, 4)), rng.normal(size=(5, 4)))
    v = rng.normal(size=(50, 8))
    a, b = index._halves(v)
    whole = (a[:, :, None] + b[:, None, :]).reshape(50, -1)
    for n in (1, 7, 30):
        cells = index.nearest_cells(v, n)
        assert np.allclose(np.take_along_axis(whole, cells, 1), np.sort(whole, axis=1)[:, :n])


def test_repeated_rows_and_empty(spark):
    same = [(1, [1.0, 2.0], 0, None, None)] * 2 + [(2, [1.0, 2.0], 0, None, None)]
    got = em.near_duplicates(spark.createDataFrame(same, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True)] * 2 + [(2, 1, 1, False)]
    assert em.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
