"""The registry in key buckets: what a change rewrites, how buckets are cut, and that nothing gets lost."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

import model
from taskfold.operators.changelog import project_clock, replay
from taskfold.sources import buckets
from taskfold.sources.documents import flatten_documents
from taskfold.streaming import merge, feeds
from test_changelog import NEW, doc


def apply(spark, root, version, docs, **more):
    documents = model.spark_documents(spark, docs)
    log = flatten_documents(documents)
    own = buckets.touched(spark, root, version, log)
    clock = project_clock(documents)
    return buckets.rewrite(spark, root, version, own, lambda base: replay(base, log, clock), clock, **more)


def many(projects, items, seq=1):
    return [doc(seq, [{"id": f"i{k}", **NEW} for k in range(items)], [], f"p{p}") for p in projects]


def test_a_small_batch_rewrites_little(spark, tmp_path):
    root = str(tmp_path)
    buckets.create(spark, root)
    assert apply(spark, root, 0, many(range(200), 20), bucket_rows=22) == 4000
    sizes = lambda v: {
        p: p.stat().st_size for p in pathlib.Path(f"{root}/data/v={v}").rglob("*.parquet") if not p.name.startswith(".")
    }
    whole = sizes(1)
    rows = apply(spark, root, 1, [doc(2, [{"id": "i3", "name": "new"}], ["i4"], f"p{p}") for p in (7, 170)], bucket_rows=22)
    assert rows <= 80 and sum(sizes(2).values()) <= 0.02 * sum(whole.values())
    assert sizes(1) == whole  # what version 1 wrote stays as it is
    now = buckets.registry(spark, root)
    assert now.count() == 3998 and now.filter("name = 'new'").count() == 2
    assert buckets.registry(spark, root, 1).count() == 4000


def test_buckets_are_cut_and_cover_every_key_once(spark, tmp_path):
    root = str(tmp_path)
    buckets.create(spark, root)
    rng = random.Random(5)
    docs, v = [], 0
    for seq in range(1, 6):  # one project holds most items
        batch = [doc(seq, [{"id": f"{seq}-{k}", **NEW} for k in range(150)], [], "hot")]
        batch += [doc(seq, [{"id": f"{seq}-{k}", **NEW} for k in range(rng.randrange(4))], [], f"p{rng.randrange(9)}") for _ in range(1)]
        docs += batch
        apply(spark, root, v, batch, bucket_rows=100, fold_clocks_every=2)
        v += 1
    final = buckets.manifest(spark, root, v)
    sizes = [r.n_rows for r in final.collect()]
    assert max(sizes) <= 200 and 4 <= len(sizes) <= 64
    keys = spark.range(5000).selectExpr("concat('p', id % 50) AS project_id", "concat('i', id) AS id")
    assert buckets._in_buckets(keys, final).count() == 5000 and sum(2.0 ** -(r.p_depth + r.i_depth) for r in final.collect()) == 1.0
    expected, _ = model.replay(docs)
    assert model.spark_rows(buckets.registry(spark, root)) == model.rows_of(expected)


def test_scores_follow_the_clock_of_the_project(spark, tmp_path):
    root = str(tmp_path)
    buckets.create(spark, root)
    apply(spark, root, 0, [doc(1, [{"id": "a", **NEW}], [], "p"), doc(1, [{"id": "a", **NEW}], [], "q")])
    before = {r.project_id: r.recency_score for r in buckets.registry(spark, root).collect()}
    empty = doc(900_000, [], [], "p")
    rows = apply(spark, root, 1, [empty])
    after = {r.project_id: r.recency_score for r in buckets.registry(spark, root).collect()}
    assert rows == 0 and after["q"] == before["q"] and after["p"] < before["p"]
    expected, _ = model.replay([doc(1, [{"id": "a", **NEW}], [], "p"), doc(1, [{"id": "a", **NEW}], [], "q"), empty])
    assert model.spark_rows(buckets.registry(spark, root)) == model.rows_of(expected)


def test_vacuum_keeps_what_is_read(spark, tmp_path):
    root = str(tmp_path)
    buckets.create(spark, root)
    for v in range(4):
        apply(spark, root, v, [doc(v + 1, [{"id": f"i{v}", **NEW}], [f"i{v - 1}"], "p")])
    before = model.spark_rows(buckets.registry(spark, root))
    assert buckets.vacuum(spark, root, keep=1) == 3 and buckets.versions(spark, root) == [4]
    assert model.spark_rows(buckets.registry(spark, root)) == before
    with pytest.raises(FileNotFoundError):
        buckets.registry(spark, f"{root}/none")


def test_stream_cuts_buckets(spark, tmp_path):
    root = str(tmp_path)
    docs = model.valid_documents(21, n_docs=10)
    last = sorted({d["batch_seq"] for d in docs})
    for low in (last[: len(last) // 2], last[len(last) // 2 :]):
        feeds.arrive(model.spark_documents(spark, [d for d in docs if d["batch_seq"] in low]), f"{root}/inbox")
        merge.merge_stream(merge.document_stream(spark, f"{root}/inbox"), root, f"{root}/cp", bucket_rows=3).awaitTermination()
    expected, _ = model.replay(docs)
    assert model.spark_rows(merge.current(spark, root)) == model.rows_of(expected)
    assert buckets.manifest(spark, f"{root}/registry", 2).agg(F.max(F.col("p_depth") + F.col("i_depth"))).first()[0] >= 2
