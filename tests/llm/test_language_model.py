"""Language-model scores: the base against plain counts, the model against its own sums and held-out texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from taskfold.llm import language_model as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words = lambda t: WORD.findall((t or "").translate(LOWER))
left = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 7


def brute(rows):
    c, texts = Counter(), 0
    for i, t in rows:
        if left(i) not in (None, 2):
            c.update(words(t))
            texts += 1
    n, v = sum(c.values()) + texts, len(c) + (texts > 0)
    log = lambda x: math.log10((x + 1) / (n + v + 1))
    return {
        k: (i, left(i) == 2, len(words(t)) + 1, sum(c[w] > 0 for w in words(t)) + (texts > 0), n, sum(log(c[w]) for w in words(t)) + log(texts))
        for k, (i, t) in enumerate(rows)
    }


def corpus():
    """Texts in which each word tells much about the next."""
    rng = random.Random(5)
    rows = []
    for i in range(700):
        w, at = [], rng.randrange(40)
        for _ in range(rng.randrange(5, 150)):
            at = (at * 7 + 3 + rng.choice([0, 0, 0, 1])) % 40
            w.append(f"Wö{at}" if rng.random() < 0.9 else f"rare{rng.randrange(3000)}")
        rows.append((i, " ".join(w)))
    return rows + [(700, None), (701, ""), (702, "wö1\x0bWö2"), (703, "x " * 40000), (703, "x " * 40000), (None, "wö1")]


def test_base_and_model(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0.0, "b") for i, t in rows], "doc_id long, text string, score double, block string")
    for block_bytes in (1 << 24, 50_000):
        got = lm.scored(df, per_root=1, block_bytes=block_bytes).collect()
        key = lambda r: repr((r[0], r[2]))
        for a, b in zip(sorted(got, key=key), sorted(brute(rows).values(), key=key), strict=True):
            assert tuple(a)[:5] == b[:5] and math.isclose(a["base_score"], b[5], rel_tol=1e-9)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 700]
    assert sum(r["score"] for r in held) > 0.85 * sum(r["base_score"] for r in held)


def test_vocabulary_grows_with_distinct_words(spark):
    """Own outcomes and classes: at most per_root * sqrt(V) words, a quarter as many classes, none missing."""
    for distinct in (100, 2500):
        counts = spark.createDataFrame([(i, 1 + (i % 50), i * 7919) for i in range(distinct)], "hash long, c long, ending long")
        most = 4 * math.isqrt(distinct)
        own, rest = lm._words_of_own(counts, most)
        found = {r["hash"]: r["c"] for r in own.collect()}
        assert len(found) <= most and len(found) + rest.count() == distinct
        assert len(found) > most - distinct // 50 and min(found.values()) > max(r["c"] for r in rest.collect())


def test_classes_are_equal_in_numpy_and_sql(spark):
    endings = [0, 97, 97 << 16 | 98 << 8 | 99, (1 << 24) - 1]
    for n in (1, 7, 1000):
        df = spark.createDataFrame([(e,) for e in endings], "e long").select(lm.class_of(lm.F.col("e"), n).alias("k"))
        assert [r["k"] for r in df.collect()] == lm.class_of(np.array(endings), n).tolist()


def test_endings_are_the_last_three_bytes():
    texts = ["a Bc dEf  lmnö", "", "x"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    _, endings, owner = lm.hashed_words(np.frombuffer(data, np.uint8), offsets)
    want = [int.from_bytes(w.encode()[-3:]) for w in ("a", "bc", "def", "lmnö", "x")]
    assert endings.tolist() == want and owner.tolist() == [0, 0, 0, 0, 2]


def small_model(words, size=4):
    return lm.LogBilinear.started(np.arange(words, dtype=np.uint64), np.arange(1.0, words + 1), np.array([5.0, 2.0]), 3, size)


def test_probabilities_sum_to_one():
    """Over all outcomes, trained or not; and over all words, with one unknown word of each class."""
    model = small_model(30)
    n = len(model.frequency)
    trainer, rng = lm.Trainer(model, 8, 0.1, 1), np.random.default_rng(3)
    for _ in range(30):
        trainer.step(*rng.integers(0, n, (3, 100)))
    for m in (model, trainer.m):
        for far, near in rng.integers(0, n, (20, 2)):
            p = np.exp(m.log_probability(np.full(n, far), np.full(n, near), np.arange(n)))
            assert abs(p.sum() - 1) < 1e-5
    assert sorted([*model.of_word, *model.of_class, model.end]) == list(range(n))
    counts = {0: [4, 1], 1: [2]}  # of the words of each class
    assert all(abs(sum((c + 1) / (sum(x) + len(x) + 1) for c in [*x, 0]) - 1) < 1e-12 for x in counts.values())


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    word = rng.integers(0, 20, 40000)
    word[1::2] = (word[::2] * 3 + 1) % 20
    model = lm.LogBilinear.started(np.arange(20, dtype=np.uint64), np.bincount(word, minlength=20).astype(float), np.zeros(1), 0, 8)
    word = model.numbers(word.astype(np.uint64), np.zeros(len(word), np.int64))
    far, near, word = word[:-2], word[1:-1], word[2:]
    trainer = lm.Trainer(model, 16, 0.1, 1)
    for _ in range(5):
        for i in range(0, len(word), 1000):
            trainer.step(far[i : i + 1000], near[i : i + 1000], word[i : i + 1000])
    loss = lambda m: -m.log_probability(far, near, word).mean()
    assert loss(trainer.m) < loss(model) - 0.3


def test_a_block_is_scored_in_runs(monkeypatch):
    """Equal scores however many texts are scored at a time; the arrays of all tokens of a block stay few."""
    import tracemalloc

    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, rng.integers(0, 60))) for _ in range(4000)] + ["", "w1 " * 9000]
    n = len(texts)
    own = lm.pa.table({"doc_id": range(n), "held_out": [False] * n, "learn": [i % 3 > 0 for i in range(n)], "text": texts})
    told = lm.pa.table({"hash": lm.pa.array([], lm.pa.int64()), "c": lm.pa.array([], lm.pa.int64())})
    model = small_model(30)
    rest = np.zeros(len(model.frequency), np.int64)
    rest[model.of_class] = 1000
    tables, tokens = [], sum(len(words(t)) for t in texts)
    for run in (1 << 18, 5000, 1):
        monkeypatch.setattr(lm, "RUN", run)
        tracemalloc.start()
        tables.append(lm._scored_block(own, told, model, rest, n, 10**5, 10**5 + 300))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    for t in tables[1:]:
        assert t.drop_columns("score").equals(tables[0].drop_columns("score"))
        assert np.allclose(t.column("score"), tables[0].column("score"), rtol=1e-5)
    assert peak < 64 * tokens
    want = [sum(len(words(t)) for t in texts[i : i + 1]) + 1 for i in range(n)]
    assert tables[0].column("n_tokens").to_pylist() == want


def test_a_step_sums_the_noise_of_each_group():
    """One step against plain sums, whatever the number of tokens a group has."""
    model, rng = small_model(30), np.random.default_rng(4)
    n = len(model.frequency)
    far, near, word = rng.integers(0, n, (3, 200))
    word[:120] = 3
    one, other = lm.Trainer(model, 8, 0.1, 1), lm.Trainer(model, 8, 0.1, 1)
    one.step(far, near, word)
    try:
        size, lm.BLOCK = lm.BLOCK, 1
        other.step(far, near, word)
    finally:
        lm.BLOCK = size
    for name in one.tables:
        assert np.allclose(one.tables[name], other.tables[name], rtol=1e-3, atol=1e-5)


def test_scores_do_not_change_with_partitions(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    key = lambda r: repr(r[:3])
    few, many = (sorted(lm.scored(df.repartition(n), block_bytes=50_000).collect(), key=key) for n in (4, 40))
    assert all(tuple(a)[:5] == tuple(b)[:5] and math.isclose(a["score"], b["score"], rel_tol=1e-4) for a, b in zip(few, many, strict=True))


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm.scored(df.limit(0)).collect() == []
    only_held = next(i for i in range(100) if left(i) == 2)
    (row,) = lm.scored(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).collect()
    assert tuple(row)[:6] == (only_held, True, 3, 0, 0, 0.0) and row["score"] < 0
