"""Decontamination against a window-by-window version."""

import hashlib
import random
import re

from taskfold.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, n=13):
    out = []
    for i, text in docs:
        w, hit, of = words(text), set(), set()
        for item, t in items:
            v = words(t)
            if item is None or not v:
                continue
            k = min(n, len(v))
            own = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in own:
                    hit |= set(range(j, j + k))
                    of.add(item)
        out.append((i, len(w), len(hit), sorted(of), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choice(["Ab", "bé", "c3", "d", "e-f", "ÄÖ", "g."]) + str(rng.randrange(40)) for _ in range(n))
    items = [(i, some(rng.randrange(1, 40))) for i in range(30)] + [(40, None), (41, ""), (42, "..."), (None, "zz yy"), (7, "second text of seven")]
    docs = [None, "", "--", "word"]
    for n in range(120):
        item = words(items[n % 30][1])
        part = item[rng.randrange(len(item)) :]
        docs.append(some(rng.randrange(80)) + " " + ", ".join(part).upper() + "! " + some(rng.randrange(200)))
    docs += docs[5:15] + ["zz yy", "Second, text... OF seven", some(20000) + " " + items[3][1]]
    return list(enumerate(docs)) + [(None, items[0][1])], items


def test_against_windows(spark):
    docs, items = cases()
    df = spark.createDataFrame([(i, t, "s", 3) for i, t in docs], "doc_id long, text string, items string, n_hit int")
    for limit in (1 << 20, 600):
        got = dc.decontaminated(df, spark.createDataFrame(items, "item_id long, text string"), item_bytes=limit)
        rows = got.select("row.doc_id", "n_words", "n_hit", "items", "contaminated").collect()
        assert sorted((tuple(r) for r in rows), key=repr) == brute(docs, items)


def test_spans_are_places_in_the_original(spark):
    item = "Один two THREE four five six seven eight nine ten eleven twelve thirteen fourteen"
    text = "Ünd: (" + item.replace(" ", ",  ").replace("THREE", "three") + ") end"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = dc.decontaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string"))
    (span,) = next(r["spans"] for r in got.collect() if r["n_hit"])
    assert text[span["first"] : span["end"]] == text[6:-5]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    (row,) = dc.decontaminated(docs, items).collect()
    assert (row["n_words"], row["n_hit"], row["items"], row["contaminated"]) == (2, 0, [], False)
    assert dc.decontaminated(docs.limit(0), items).collect() == []


def test_digest_of_no_items(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, "a"), (10, "b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    (row,) = dc.op2_benchmark_decontamination(spark, str(tmp_path)).collect()
    assert row["items_sha256"] == hashlib.sha256(b"10,9").hexdigest() and row["n_items"] == 2
