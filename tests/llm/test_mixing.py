"""Pfair mixing: windows, deviation, and positions against a plain version."""

import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st

from taskfold.llm import mixing as mx


@settings(deadline=None, max_examples=60)
@given(st.lists(st.floats(0.01, 100), min_size=1, max_size=12), st.integers(12, 300))
def test_schedule_keeps_within_a_block(weights, quantum):
    parts = mx.shares({f"s{i}": w for i, w in enumerate(weights)}, quantum)
    assert sum(parts.values()) == quantum and min(parts.values()) >= 1
    had = dict.fromkeys(parts, 0)
    for n, (s, j, release, deadline, slot) in enumerate(mx.schedule(parts, quantum)):
        assert slot == n and j == had[s] and release <= slot < deadline
        had[s] += 1
        for x in parts:
            assert abs(had[x] - parts[x] * (n + 1) / quantum) < 1
    assert had == parts


def test_bad_weights():
    with pytest.raises(ValueError):
        mx.shares({"a": 0.0}, 10)
    with pytest.raises(ValueError):
        mx.shares({str(i): 1.0 for i in range(11)}, 10)


def brute(rows, weights, block_bytes, quantum):
    parts = mx.shares(weights, quantum)
    slot = {(s, j): (t, r, d) for s, j, r, d, t in mx.schedule(parts, quantum)}
    used, out = {}, []
    order = sorted(rows, key=lambda r: (hashlib.md5(b"mix" + ("" if r[0] is None else str(r[0])).encode()).hexdigest(), len((r[1] or "").encode())))
    total = {}
    for i, text, source in order:
        source, n = source or "", len((text or "").encode())
        total[source] = total.get(source, 0) + n
        b = used.get(source, 0) // block_bytes
        used[source] = used.get(source, 0) + n
        if source in parts:
            t, r, d = (x + b // parts[source] * quantum for x in slot[source, b % parts[source]])
        else:
            t = r = d = None
        out.append((i, source, n, b, t, r, d))
    full = {s: max(1, -(-total[s] // block_bytes)) if s in total else 0 for s in parts}
    horizon = min(b // parts[s] * quantum + slot[s, b % parts[s]][0] for s, b in full.items())
    return [(*r, r[4] is not None and r[4] < horizon) for r in out]


@pytest.mark.parametrize("chunk_rows", [10_000, 20])
def test_positions(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(mx, "CHUNK_ROWS", chunk_rows)
    rng = random.Random(3)
    rows = [(i, "é" * rng.randrange(200), "hot" if i % 3 else rng.choice(["a", "b", None, "no weight"])) for i in range(900)]
    rows += [(None, "x", "a"), (None, "x", "a"), (5000, None, "b"), (5001, "", "hot"), (5002, "long" * 5000, "a")]
    weights = {"hot": 0.5, "a": 0.2, "b": 0.2, "": 0.1}
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, slot string, n_bytes int")
    got = [tuple(r) for r in mx.mixed(df, weights, block_bytes=1000, quantum=50).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, weights, 1000, 50), key=repr)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_default_weights_and_empty(spark):
    df = spark.createDataFrame([(1, "abcd", "a"), (2, "b", "b")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mx.mixed(df, quantum=3).collect()}
    assert got[1]["slot"] == 0 and got[2]["slot"] in (1, 2)
    assert mx.mixed(df.limit(0)).collect() == []


def test_more_sources_than_quantum(spark):
    rows = [(i, "x" * (i + 1), f"s{i}") for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in mx.mixed(df, block_bytes=1000, quantum=3).collect()]
    assert sorted(got) == sorted(brute(rows, {s: len(t) ** 0.5 for _, t, s in rows}, 1000, 9))
