"""Runs of words against a version that tries every period."""

import hashlib
import random
import zlib

import pytest

from taskfold.llm import periods as pr


def brute_runs(x):
    out = set()
    n = len(x)
    for q in range(1, n // 4 + 1):
        s = 0
        while s < n:
            e = s
            while e + q < n and x[e] == x[e + q]:
                e += 1
            if e > s and e + q - s >= max(6, 4 * q):
                part = x[s : e + q]
                if all(any(part[i] != part[i + d] for i in range(len(part) - d)) for d in range(1, q)):
                    out.add((s, e + q - s, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_lyndon(x):
    n = len(x)
    return [next((j for j in range(i + 1, n) if x[j:] < x[i:]), n) - i for i in range(n)]


def brute_row(doc_id, text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[0] if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None,
        sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_lyndon_arrays_of_both_orders():
    rng = random.Random(1)
    for _ in range(1500):
        x = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(40))]
        assert pr.lyndon_array(x) == brute_lyndon(x)
        back = [-v for v in x]
        assert pr.lyndon_array(back) == brute_lyndon(back)


def test_runs_of_random_sequences():
    rng = random.Random(2)
    for _ in range(1500):
        x = []
        while len(x) < 70:
            unit = [rng.randrange(rng.choice([2, 3, 20])) for _ in range(rng.randrange(1, 9))]
            x += (unit * 8)[: rng.randrange(1, 6 * len(unit) + 1)] if rng.random() < 0.6 else unit
        assert pr.word_runs(x) == brute_runs(x), x


@pytest.mark.parametrize("x", [[], [1], [1] * 5, [1] * 6, [1, 2] * 3, [1, 2] * 4, [1, 2] * 4 + [1], [1, 1, 2] * 4 + [1, 1, 1, 1, 1, 1]])
def test_edges(x):
    assert pr.word_runs(x) == brute_runs(x)


def test_long_runs_take_no_quadratic_time():
    x = [0, 1, 2] * 200_000
    assert pr.word_runs(x) == [(0, 600_000, 3)]
    assert pr.word_runs([7] * 300_000 + [1]) == [(0, 300_000, 1)]


def rows():
    rng = random.Random(3)
    out = [(None, None, 1), (None, "a " * 9, 2), (1, None, 3), (2, "", 4), (3, " \t\n", 5), (4, "Wort\x0bwort " * 5, 6), (5, "é ü  " * 40, 7)]
    for i in range(10, 320):
        unit = [rng.choice(["the", "of", "né", "w%d" % rng.randrange(50)]) for _ in range(rng.randrange(1, 7))]
        text = " ".join(["x%d" % rng.randrange(9)] * rng.randrange(8) + unit * rng.randrange(7) + ["w%d" % rng.randrange(99) for _ in range(rng.randrange(60))])
        out.append((i, text, i))
    return out + out[20:30]


def test_query_against_brute_force(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, "doc_id long, text string, `start of run` long").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in pr.op13_periodic_runs(spark, str(tmp_path)).collect()]
    want = [brute_row(i, t) for i, t, _ in data]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 60


def test_operator_gives_texts_and_takes_odd_tables(spark):
    odd = spark.createDataFrame([(1, "go " * 7 + "on", 5)], "doc_id int, text string, `a.b c` int")
    row = pr.periodic_runs(odd).first()
    assert row["collapsed"] == "go on" and [tuple(r) for r in row["runs"]] == [(0, 7, 1)]
    assert pr.periodic_runs(odd.limit(0)).collect() == []
