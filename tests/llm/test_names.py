"""Extra columns with any name, empty tables and a very long text, through the operators that carry whole rows."""

import corpus_pipeline as cp
from taskfold.llm import chunks, decontaminate, licenses, minhash, toxicity

ODD = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `row` string, `x: y z` int, `found` int, `ti``ck` int"


def odd_docs(spark):
    rows = [(i, f"some text {i} with words enough to count {i * 7}", "en", "s", 9, i, "r", None, 1, i) for i in range(6)]
    return spark.createDataFrame(rows + [(7, None, None, None, None, None, None, None, None, None)], ODD)


def test_columns_of_any_name(spark):
    docs = odd_docs(spark)
    items = spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string")
    model = toxicity.fitted(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    for out in (decontaminate.decontaminated(docs, items), toxicity.scored(docs, model), chunks.deduplicated(docs), licenses.scanned(docs)):
        assert out.select("row.*").columns == docs.columns
        assert sorted(map(repr, out.select("row.*").collect())) == sorted(map(repr, docs.collect()))
    assert minhash.near_duplicates(docs).count() == 7


def test_pipeline_with_odd_names_and_with_empty_tables(spark, tmp_path):
    for name, docs in (("odd", odd_docs(spark)), ("empty", odd_docs(spark).limit(0))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)] if name == "odd" else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = cp.run(spark, folder)
        assert out.count() == docs.count() and out.select("doc_id").distinct().count() == docs.count()


def test_a_very_long_text(spark):
    text = " ".join(f"word{i % 9973} of" for i in range(500_000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    assert len(text) > 5_000_000
    item = spark.createDataFrame([(1, " ".join(text.split()[700_000:700_020]))], "item_id long, text string")
    hit = {r["row"]["doc_id"]: r for r in decontaminate.decontaminated(docs, item).select("row.doc_id", "row", "n_words", "n_hit").collect()}
    assert hit[1]["n_words"] == 1_000_000 and hit[1]["n_hit"] > 0
    assert licenses.scanned(docs).filter("size(found) > 0").isEmpty()
    model = toxicity.Model((toxicity.Term("word77", False),), frozenset(), {(0, e, q): 0.9 for e in (0, 1) for q in (False, True)}, 0.01)
    assert {r["row"]["doc_id"]: r["predicted"] for r in toxicity.scored(docs, model).collect()} == {1: 1, 2: 0}
