"""License scans against every window of the grid."""

import random
import re

import pytest

from taskfold.llm import licenses as lc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def brute(text, templates, least=0.8):
    s, out = shingles(text), set()
    for name, t in templates:
        own = shingles(t)
        if not own:
            continue
        m = lc.Templates.size_class(len(own))
        step = lc.Templates.stride(m)
        for a in range(0, len(s), step):
            if len(set(own) & set(s[a : a + m + step])) / len(set(own)) >= least:
                out.add(name)
    return out


def texts():
    rng = random.Random(8)
    some = lambda n: " ".join(f"Wört{rng.randrange(900)}" for _ in range(n))
    out = [None, "", "MIT", "free use", some(3000), lc.TEMPLATES[3][1] * 3]
    for i in range(150):
        w = lc.TEMPLATES[i % len(lc.TEMPLATES)][1].split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "changed"
        out.append(f"{some(rng.randrange(60))}. «{' '.join(w).upper() if i % 2 else '  '.join(w)}»\n{some(rng.randrange(60))}")
    return out


def test_against_every_window(spark):
    templates = [*lc.TEMPLATES, ("two", "free use"), ("none", "..."), ("long", " ".join(f"w{i}" for i in range(400)))]
    rows = list(enumerate(texts() + [" ".join(f"w{i}" for i in range(30, 400))])) + [(None, templates[0][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, found string")
    got = lc.scanned(df, templates).select("row.doc_id", "found.license").collect()
    assert sorted(((r[0], sorted(set(r[1]))) for r in got), key=repr) == sorted(((i, sorted(brute(t, templates))) for i, t in rows), key=repr)


def test_place_in_the_original(spark):
    text = "Ünd das: Licensed under the  Apache License; version 2.0!"
    (row,) = lc.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    (found,) = row["found"]
    assert (found["license"], found["containment"]) == ("Apache-2.0", 1.0)
    assert text[found["first"] : found["end"]] == "Licensed under the  Apache License; version 2.0"


def test_empty_and_bound(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Released under the MIT License")] * 2, "doc_id long, text string")
    assert [len(r["found"]) for r in lc.scanned(df).collect()] == [1, 1]
    assert [len(r["found"]) for r in lc.scanned(df, []).collect()] == [0, 0]
    assert lc.scanned(df.limit(0)).collect() == []
    monkeypatch.setattr(lc, "TEMPLATE_BYTES", 10)
    with pytest.raises(ValueError):
        lc.scanned(df)


def test_short_notices_in_longer_texts(spark):
    gpl2, agpl = ({n: t for n, t in lc.NOTICES}[x] for x in ("GPL-2.0", "AGPL-3.0"))
    rows = ["Über uns. © 2020 ACME. All  Rights Reserved. All rights reserved, and more text", f"intro {gpl2} and so on", f"x {agpl} y", "all rights are reserved", "free use " * 3]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["found"] for r in lc.scanned(df).collect()}
    names = {i: [f["license"] for f in found] for i, found in got.items()}
    assert names == {0: ["All-Rights-Reserved"] * 2, 1: ["GPL-2.0"], 2: ["AGPL-3.0"], 3: [], 4: []}
    assert [rows[0][f["first"] : f["end"]] for f in got[0]] == ["All  Rights Reserved", "All rights reserved"]
    own = lc.scanned(df, [("two", "use free"), ("one", "ACME")]).collect()
    assert {r["row"]["doc_id"]: [f["license"] for f in r["found"]] for r in own} == {0: ["one"], 1: [], 2: [], 3: [], 4: ["two", "two"]}
