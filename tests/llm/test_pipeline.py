"""The stages one after another, against what was planted and the plain versions of the operators."""

import random

import corpus_pipeline as cp

from tests.llm import test_decontaminate, test_minhash


def corpus():
    rng = random.Random(11)
    some = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        rows.append((i, some(100) + (" idiot moron idiot" if toxic else ""), "en", f"src{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    copy = rows[1][1].split()
    copy[50] = "changed"
    passage, item = some(70), some(30)
    rows += [(1000, " ".join(copy), "en", "src0", 0), (1001, rows[2][1], "en", "src1", 0)]
    rows += [(1100 + i, f"{some(60)} {passage} {some(60)}", "en", "src2", 0) for i in range(3)]
    rows += [(1200, f"{some(40)} {item} {some(40)}", "en", "src0", 0), (1300, None, None, None, None), (1301, "", "en", "src0", 0)]
    return rows, labels, [(1, item), (2, some(20))], passage


def test_stages(spark, tmp_path):
    rows, labels, items, passage = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in cp.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r["doc_id"]: r for r in docs.collect()}
        seen.append(name)
        if name == "toxicity":
            assert set(after) == {r[0] for r in rows if "idiot" not in (r[1] or "")}
        if name == "near_duplicates":
            kept = {r[0] for r in test_minhash.brute([b[:2] for b in before], 5, 80) if r[3]}
            assert set(after) == kept and not {1000, 1001} & kept
        if name == "substring_dedup":
            assert len(after) == len(before)
            assert [passage in after[1100 + i]["text"] for i in range(3)] == [True, False, False]
            assert sum(after[b[0]]["text"] != b[1] for b in before) == 2
            assert all(r["n_chars"] == len(r["text"]) for r in after.values() if r["text"] is not None)
        if name == "decontamination":
            dirty = {r[0] for r in test_decontaminate.brute([b[:2] for b in before], items) if r[4]}
            assert dirty == {1200} and set(after) == {b[0] for b in before} - dirty
        if name != "mixing":
            assert docs.columns == columns
        else:
            assert set(after) == {b[0] for b in before} and all(r["slot"] is not None for r in after.values())
    ran = cp.run(spark, str(tmp_path))
    assert sorted(map(repr, ran.collect())) == sorted(map(repr, docs.collect())) and len(seen) == 5
