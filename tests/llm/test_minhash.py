"""MinHash near-duplicates against all pairs in plain Python."""

import random
import re

import pytest

from taskfold.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and i is not None and j is not None and len(a & b) * 100 >= len(a | b) * percent:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return sorted(
        ((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=repr
    )


def family(rng, n, words, edits):
    """A text and n variants with a few words changed."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(5000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_against_all_pairs(spark, k, percent):
    rng = random.Random(7)
    texts = [None, "", " \t\n", "one", "One", "one two", "ONE TWO", "Äb c", "a b c", "a b c\x0b", "a\x1cb c", "äb c", "x " * 30000, "X " * 29000]
    for words, n, edits in [(120, 60, 6), (40, 40, 4), (300, 25, 40), (12, 20, 2), (80, 40, 8)]:
        texts += family(rng, n, words, edits)
    texts += texts[20:60]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, texts[30]), (None, None)]
    df = spark.createDataFrame([(i, t, "src", 1, "x") for i, t in rows], "doc_id long, text string, source string, n int, component_id string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(df, k, percent).collect()), key=repr)
    assert got == brute(rows, k, percent)


def changed_copies(n, edits, vocabulary, words=60):
    """Copies whose changes come from few words, so that most are too far from each other and share much."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(words)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        w = list(base)
        for at in rng.sample(range(words), rng.randrange(*edits)):
            w[at] = f"x{rng.randrange(vocabulary)}"
        rows.append((i, " ".join(w)))
    return rows


def test_large_group_of_changed_copies_takes_two_rounds(spark, monkeypatch):
    rows, rounds, components = changed_copies(500, (1, 6), 3), [], minhash.components
    monkeypatch.setattr(minhash, "components", lambda links: rounds.append(1) or components(links))
    got = sorted((tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()), key=repr)
    assert got == brute(rows, 3, 85) and len({r[2] for r in got}) > 100
    assert len(rounds) == 2


@pytest.mark.parametrize(("large", "members"), [(8, 4), (64, 7), (4096, 30)])
def test_blocks_and_centres_of_large_buckets(spark, monkeypatch, large, members):
    """Every pair of a bucket is compared, however it is cut and however many rounds of centres come first."""
    for name, value in (("SMALL_BUCKET", 4), ("LARGE_BUCKET", large), ("BLOCK_MEMBERS", members), ("COLUMNS", 16)):
        monkeypatch.setattr(minhash, name, value)
    rows = changed_copies(160, (1, 5), 3)
    got = sorted((tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()), key=repr)
    assert got == brute(rows, 3, 85)


def test_close_in_block():
    import pyarrow as pa

    sets = [{1, 2, 3, 4}, {1, 2, 3, 4, 5}, {1, 2, 3, 9}, {7}]
    table = lambda at, comp, q: pa.table({
        "p": [0] * 4, "q": [q] * 4, "at": at, "n": [len(s) for s in sets], "comp": comp, "shared": [sorted(s) for s in sets],
    })
    links = lambda *x: {tuple(r.values()) for r in minhash._close_in_block(table(*x), 60).to_pylist()}
    assert links([0] * 4, [10, 11, 12, 13], 0) == {(10, 11), (10, 12)}
    assert links([0, 1, 0, 1], [10, 11, 12, 13], 1) == {(10, 11)}
    assert links([0] * 4, [10, 10, 12, 13], 0) == {(10, 12)}
    assert links([1] * 4, [10, 11, 12, 13], 1) == set()


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    same = minhash.near_duplicates(spark.createDataFrame([(3, "a b c d e f")] * 3 + [(2, "a b c d e f")], schema)).collect()
    assert sorted(tuple(r) for r in same) == [(2, 2, 2, True)] + [(3, 2, 2, False)] * 3


def test_one_permutation_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 64, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 64, 200, dtype=np.uint64)])
    values, owner = np.concatenate([a, b]), np.repeat([0, 1], 1000)
    s = minhash.one_permutation(values, owner, 2, 2048)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.05


@pytest.mark.parametrize("task_links", [5, 500_000])
def test_components(spark, task_links):
    from taskfold.llm.components import components

    rng = random.Random(9)
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    links += [(5, 5), (None, 3), (3, None)] + links[:5] + [(b, a) for a, b in links[5:9]]
    root = {x: x for e in links for x in e if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = components(spark.createDataFrame(links, "a long, b long"), task_links).distinct().collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root if find(x) != x)
