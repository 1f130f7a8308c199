"""Content-defined chunking against a byte-by-byte version."""

import hashlib
import random

import numpy as np

from taskfold.llm import chunks as ch


def slow_chunks(text: bytes, bits=5):
    out, h, start, before = [], 0, 0, False
    for i, b in enumerate(text):
        h = (2 * h + int(ch._GEAR[b])) & 0xFFFF
        zero = h >> (16 - bits) == 0
        inner = i + 1 < len(text) and text[i + 1] & 0xC0 != 0x80
        # the window before the first 16 bytes belongs to no text: the fast version never uses it
        if zero and not before and i + 1 >= ch.WINDOW and inner:
            out.append((start, i + 1))
            start = i + 1
        before = zero
    return out + [(start, len(text))] if text else out


def brute(rows, least_run=64):
    pieces = {}
    for i, t in rows:
        t = (t or "").encode()
        pieces[i] = [t[a:b] for a, b in slow_chunks(t)]
    first = {}
    for i in sorted(pieces):
        for p in pieces[i]:
            first.setdefault(p, i)
    out = []
    for i, _ in rows:
        kept, run, removed, spans, again = [], [], 0, 0, 0
        for p in pieces[i] + [None]:
            if p is not None and first[p] < i:
                run.append(p)
                again += 1
                continue
            if sum(map(len, run)) >= least_run:
                removed += sum(map(len, run))
                spans += 1
            else:
                kept += run
            run = []
            kept += [p] if p is not None else []
        whole = b"".join(pieces[i])
        out.append((i, len(whole), len(pieces[i]), again, removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
    return sorted(out)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "bêta", "gamma", "δέλτα", "of", "the", "in"]) + str(rng.randrange(900)) for _ in range(n))


def test_against_slow_version(spark):
    rng = random.Random(3)
    passage = [words(rng, 60) for _ in range(4)]
    texts = [None, "", "short", "a" * 5000, "b" * 40, "é" * 300, words(rng, 9000)]
    for n in range(60):
        parts = [words(rng, rng.randrange(5, 80)), rng.choice(passage), words(rng, rng.randrange(40))]
        texts.append(" ".join(parts))
    texts += [texts[10], texts[11] + " and more", "x" + texts[12], texts[13][5:]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, n_removed int")
    got = ch.deduplicated(df).select("row.doc_id", "n_bytes", "n_chunks", "n_repeated", "n_removed", "n_spans", "kept_sha256")
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_repeated_passage_goes_and_the_rest_stays(spark):
    rng = random.Random(4)
    passage = words(rng, 60)
    mine = [words(rng, 50) for _ in range(4)]
    rows = [(1, f"{mine[0]} {passage} {mine[1]}"), (2, f"{mine[2]} {passage} {mine[3]}"), (None, passage), (None, None)]
    got = {r["row"]["doc_id"]: r for r in ch.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] == rows[0][1] and passage not in got[2]["kept"]
    assert mine[2] in got[2]["kept"] and mine[3] in got[2]["kept"]
    assert got[2]["n_removed"] > len(passage.encode()) * 0.6


def test_empty_and_shared_ids(spark):
    schema = "doc_id long, text string"
    assert ch.deduplicated(spark.createDataFrame([], schema)).collect() == []
    text = words(random.Random(5), 200)
    rows = ch.deduplicated(spark.createDataFrame([(1, text)] * 2 + [(2, text)], schema)).collect()
    assert sorted((r["row"]["doc_id"], r["n_removed"]) for r in rows) == [(1, 0), (1, 0), (2, len(text.encode()))]


def test_long_text_in_pieces():
    data = np.random.default_rng(0).integers(97, 123, 9 << 20, dtype=np.uint8)
    starts, ends, owner = ch.chunks(data, np.array([0, len(data)]))
    pieces = ch._digests(data, starts, ends)
    some = slice(100000, 100200)
    low = starts[100000]
    again = ch._digests(data[low : ends[100199]], starts[some] - low, ends[some] - low)
    assert (pieces[some] == again).all() and not owner.any()
