"""Suffix dedup against a set of all 50-byte strings; runs and merging against sorting."""

import hashlib
import random

import numpy as np
import pytest

from taskfold.llm import suffixes as sx


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for s in {b[p : p + 50] for p in range(len(b) - 49)}:
                first[s] = min(i, first.get(s, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - 49):
                if first[b[p : p + 50]] < i:
                    gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdé \n\0x") for _ in range(n))
    shared = [some(n) for n in (20, 49, 50, 51, 60, 90, 200)]
    texts = [None, "", "a" * 49, "a" * 50, "a" * 51, "a" * 400, "ab" * 300, "abc" * 100, "é" * 80, some(5000)]
    for _ in range(120):
        parts = [some(rng.randrange(90)), rng.choice(shared), some(rng.randrange(70)), rng.choice(shared)[rng.randrange(10) :], some(rng.randrange(30))]
        texts.append("".join(parts))
    texts += texts[20:40] + [texts[30][:-3] + "zz", "q" + texts[31], texts[9][100:3000] + texts[9][50:200]]
    rng.shuffle(texts)
    return list(enumerate(texts, 5)) + [(None, texts[50]), (None, None)]


@pytest.mark.parametrize("rows_of_a_part", [(1_000_000, 200_000), (50, 20)])
def test_against_all_strings(spark, monkeypatch, rows_of_a_part):
    monkeypatch.setattr(sx, "ASK_ROWS", rows_of_a_part[0])
    monkeypatch.setattr(sx, "RUN_ROWS", rows_of_a_part[1])
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, kept string, place int").repartition(5)
    got = sx.deduplicated(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_repeated_rows_and_empty(spark):
    schema = "doc_id long, text string"
    text = "some text that is longer than fifty bytes, and stands here twice"
    got = sx.deduplicated(spark.createDataFrame([(3, text)] * 2 + [(4, text)], schema)).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept"]) for r in got) == [(3, 0, text)] * 2 + [(4, len(text), "")]
    assert sx.deduplicated(spark.createDataFrame([], schema)).collect() == []


def test_a_string_twice_in_the_later_document(spark):
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    s = some(80)
    rows = [(i, some(300) + s + some(40) + (s + some(50)) * (i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    got = sx.deduplicated(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_windows_share_their_anchor():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 100, 30_000, dtype=np.uint8)
    other = np.concatenate([rng.integers(97, 100, 777, dtype=np.uint8), text[1000:1050], rng.integers(97, 100, 50, dtype=np.uint8)])
    a = sx.anchors(text, np.array([0, len(text)]))[0]
    b = sx.anchors(other, np.array([0, len(other)]))[0]
    assert {x - 1000 for x in a if 1000 <= x <= 1030} & {x - 777 for x in b if 777 <= x <= 807}
    for s in range(len(text) - 49):
        assert ((a >= s) & (a <= s + 30)).any()
        if s > 2000:
            break


def test_long_text_in_pieces(monkeypatch):
    text = np.random.default_rng(2).integers(97, 101, 50_000, dtype=np.uint8)
    whole = sx.anchors(text, np.array([0, len(text)]))
    monkeypatch.setattr(sx, "PIECE", 700)
    parts = sx.anchors(text, np.array([0, len(text)]))
    assert all((x == y).all() for x, y in zip(whole, parts))


def test_runs_and_merge():
    rng = random.Random(3)
    runs = [sorted({bytes(rng.choice(b"ab") for _ in range(sx.KEY)) if rng.random() < 0.5 else b"a" * rng.randrange(sx.KEY) + b"b" * 99 for _ in range(rng.randrange(40))}) for _ in range(7)]
    runs = [sorted({k[: sx.KEY] for k in r}) for r in runs] + [[]]
    coded = [sx.front_coded(np.frombuffer(b"".join(r), np.uint8).reshape(-1, sx.KEY)) if r else (b"", b"") for r in runs]
    assert [[k for k, _ in sx.decoded(*c)] for c in coded] == runs
    out = list(sx.merged([sx.decoded(*c) for c in coded]))
    assert [k for k, _, _ in out] == sorted(k for r in runs for k in r)
    for (x, _, _), (y, _, common) in zip(out, out[1:]):
        assert common == next((i for i in range(sx.KEY) if x[i] != y[i]), sx.KEY)
