import os
import subprocess
import sys

import pytest

import model
from taskfold.plans import catalog
from taskfold.schema import FEATURE
from taskfold.streaming import feeds, keyed_state, merge
from taskfold.sources import buckets
from taskfold.sources.documents import checked_documents
from test_changelog import NEW, doc


def thirds(spark, docs):
    last = max(d["batch_seq"] for d in docs) + 1
    cut = [d["batch_seq"] * 3 // last for d in docs]
    return [model.spark_documents(spark, [d for d, c in zip(docs, cut) if c == part]) for part in range(3)]


def test_merge_stream_is_the_replay(spark):
    docs = model.valid_documents(11, n_docs=12)
    expected, _ = model.replay(docs)
    assert model.spark_rows(feeds.merged_by_batches(spark, thirds(spark, docs), compact_every=2)) == model.rows_of(expected)


def test_lenient_merge_stream(spark):
    docs = model.random_documents(12, n_docs=12)
    expected, verdicts = model.replay(docs, lenient=True)
    assert not all(verdicts.values())
    assert model.spark_rows(feeds.merged_by_batches(spark, thirds(spark, docs), lenient=True)) == model.rows_of(expected)


def test_bad_document_stops_the_stream_and_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    def run(docs):
        feeds.arrive(model.spark_documents(spark, docs), f"{root}/inbox")
        merge.merge_stream(merge.document_stream(spark, f"{root}/inbox"), root, f"{root}/cp").awaitTermination()

    run([doc(1, [{"id": "a", **NEW}])])
    with pytest.raises(Exception, match="New feature 'b' requires 'name' field"):
        run([doc(2, [{"id": "a", "name": "changed"}, {"id": "b"}])])
    assert [(r.id, r.name) for r in merge.current(spark, root).collect()] == [("a", "N")]
    with pytest.raises(Exception, match="unknown status"):
        feeds.merged_by_batches(spark, [model.spark_documents(spark, [doc(1, [{"id": "a", **NEW, "status": "done"}])])])
    assert buckets.versions(spark, f"{root}/registry") == [0, 1]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    root = str(tmp_path)
    docs = [doc(1, [{"id": "a", **NEW}]), doc(2, [{"id": "b", **NEW}])]
    for d in docs:
        feeds.arrive(model.spark_documents(spark, [d]), f"{root}/inbox")
        merge.merge_stream(merge.document_stream(spark, f"{root}/inbox"), root, f"{root}/cp").awaitTermination()
    before = model.spark_rows(merge.current(spark, root))
    (tmp_path / "cp" / "commits" / "1").unlink()  # the driver died after the write, before the commit
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    merge.merge_stream(merge.document_stream(spark, f"{root}/inbox"), root, f"{root}/cp").awaitTermination()
    assert buckets.versions(spark, f"{root}/registry") == [0, 1, 2]
    assert model.spark_rows(merge.current(spark, root)) == before


def test_keyed_state(spark):
    docs = model.random_documents(13, n_docs=15)
    # One project is emptied at the end: only tombstones tell.
    docs.append(doc(16, [], [f"i{k}" for k in range(7)], "p1"))
    expected, verdicts = model.replay(docs, lenient=True)
    assert not all(verdicts.values()) and not expected["p1"]
    got = feeds.merged_by_keyed_state(spark, thirds(spark, docs), 10_000)
    assert model.spark_rows(got) == model.rows_of(expected)


def test_latest_items_needs_tombstones(spark):
    feed = spark.createDataFrame(
        [("p", 1, 1, "item", "a", '{"id":"a","name":"N","ord_batch":1}'), ("p", 2, 2, "removed", "a", None),
         ("p", 3, 3, "rejected", None, "why"), ("p", 4, 4, "item", "b", '{"id":"b","name":"M","last_updated":5}')],
        keyed_state.CHANGE_FEED)
    got = keyed_state.latest_items(feed, 5)
    assert got.columns == FEATURE.fieldNames() and [(r.id, r.recency_score) for r in got.collect()] == [("b", 1.0)]


def test_rejects_of_all_kinds(spark):
    """Every kind of text, stamped with a project where it is an object; the readable but invalid ones are rejected too."""
    stamp = '{"project_id": "p", "batch_seq": %d, "batch_ts": 9, '
    lines = [t.replace("@", "7").replace("{", stamp % i, 1) if t.startswith('{"') else t for i, t in enumerate(catalog._TEXTS)]
    got = feeds.rejects_of_lines(spark, spark.createDataFrame([(x,) for x in lines], "value string"))
    wrong = {lines[i]: "change without id" for i in (3, 13)} | {lines[5]: "unknown status"}
    found = {r.json: r.error for r in got.collect()}
    assert {k: found.get(k) for k in wrong} == wrong
    assert set(found) == set(lines) - {lines[4], lines[8]} and got.count() == 14


_MANY = """
import json, resource, sqlite3, sys
import pandas as pd
from taskfold.streaming import keyed_state

class Entries:  # a state store on disk
    def __init__(self, db, name):
        self.db, self.name = db, name
        db.execute(f"CREATE TABLE {name} (k TEXT PRIMARY KEY, v TEXT)")
    def find(self, key):
        return self.db.execute(f"SELECT v FROM {self.name} WHERE k = ?", (repr(key),)).fetchone()
    containsKey = lambda self, key: self.find(key) is not None
    getValue = find
    def updateValue(self, key, value):
        self.db.execute(f"INSERT OR REPLACE INTO {self.name} VALUES (?, ?)", (repr(key), value[0]))
    def removeKey(self, key):
        self.db.execute(f"DELETE FROM {self.name} WHERE k = ?", (repr(key),))

class Value:
    value = None
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    def update(self, value):
        self.value = value

class Handle:
    def __init__(self, path):
        self.db = sqlite3.connect(path)
        self.db.execute("PRAGMA cache_size = -2000")
        self.db.execute("PRAGMA temp_store = FILE")
    getMapState = lambda self, name, *_: Entries(self.db, name)
    getValueState = lambda self, *_: Value()

n, size = 1_000_000, 10_000
def chunks(count):
    of = count // size
    for c in range(of):  # later chunks hold documents between those of earlier ones
        seq = [k * of + c for k in range(size)]
        change = [json.dumps([{"id": "i%d" % (s % 15_000), "name": "n%d" % s, "domain": "d", "description": "x" * 40}]) for s in seq]
        yield pd.DataFrame({"project_id": "p", "batch_seq": seq, "batch_ts": seq, "features": change, "removals": ["[]"] * size})

def run(count, path):
    merge = keyed_state._processor()
    merge.init(Handle(path))
    last, rows = {}, 0
    for part in merge.handleInputRows(("p",), chunks(count), None):
        rows += len(part)
        assert len(part) <= keyed_state.FEED_ROWS
        for doc_no, item, body in zip(part["doc_no"], part["id"], part["body"]):
            last[item] = doc_no
    assert merge.count.get() == (count,) and len(last) == 15_000
    assert sorted(last.values()) == list(range(count - 15_000 + 1, count + 1))
    assert merge.waiting.db.execute("SELECT count(*) FROM waiting").fetchone() == (0,)
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024

few, many = run(20_000, sys.argv[1] + "/few"), run(n, sys.argv[1] + "/many")
print(few, many)
"""


def test_a_million_documents_of_one_project_in_one_trigger(tmp_path):
    """Ten times the documents take no more memory than some blocks."""
    out = subprocess.run(
        [sys.executable, "-c", _MANY, str(tmp_path)], capture_output=True, text=True, timeout=900,
        env={**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))},
    )
    assert out.returncode == 0, out.stderr[-2000:]
    few, many = map(int, out.stdout.split())
    assert many < 700 and many - few < 200, (few, many)


def test_chunks_and_write_backs_change_nothing(spark, monkeypatch):
    """Small chunks, blocks and caches, so that documents of one trigger go through the store."""
    make = keyed_state._processor
    monkeypatch.setattr(keyed_state, "_processor", lambda: make(block=2, kept=3, at_once=4))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        docs = model.random_documents(14, n_docs=24, n_projects=2)
        expected, _ = model.replay(docs, lenient=True)
        got = feeds.merged_by_keyed_state(spark, [model.spark_documents(spark, docs[::-1])], 10_000)
        assert model.spark_rows(got) == model.rows_of(expected)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_compacted_feed_tells_the_same(spark, tmp_path):
    folder = str(tmp_path)
    rows = [[("p", 1, 1, "item", "a", '{"id":"a"}'), ("p", 2, 2, "item", "b", '{"id":"b"}'), ("p", 3, 3, "rejected", None, "why")],
            [("p", 4, 4, "removed", "a", None), ("p", 5, 5, "item", "b", '{"id":"b","name":"new"}')],
            [("p", 6, 6, "item", "a", '{"id":"a","name":"again"}')]]
    state = lambda: sorted((r.id, r.name) for r in keyed_state.latest_items(keyed_state.stored_feed(spark, folder), 5).collect())
    assert keyed_state.compact_feed(spark, folder) is None and state() == []
    for epoch in (0, 1):
        spark.createDataFrame(rows[epoch], keyed_state.CHANGE_FEED).write.parquet(f"{folder}/epoch={epoch}")
    before = state()
    assert keyed_state.compact_feed(spark, folder) == 1 == keyed_state.compact_feed(spark, folder)
    assert state() == before == [("b", "new")]
    assert sorted(r.kind for r in keyed_state.stored_feed(spark, folder).collect()) == ["item", "rejected"]
    spark.createDataFrame(rows[2], keyed_state.CHANGE_FEED).write.parquet(f"{folder}/epoch=2")
    assert state() == [("a", "again"), ("b", "new")]


def test_documents_of_the_feed_are_parsed_once(spark):
    """The filter on errors stays above the parse, which Spark would else do again for it."""
    lines = spark.createDataFrame([('{"project_id":"p"}',)], "json string")
    plan = keyed_state.change_feed(checked_documents(lines))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") == 3  # a text as written, and two lists


def test_slices_of_a_project_are_keys_of_their_own(spark):
    docs = [d | {"features": d["features"][:1], "remove_features": d["remove_features"][: not d["features"]]}
            for d in model.random_documents(15, n_docs=40, n_projects=2)]
    docs.append(doc(90, [{"id": None, "name": "n"}], [], "p1"))
    expected, verdicts = model.replay(docs, lenient=True)
    assert not all(verdicts.values()) and any(d["remove_features"] for d in docs)
    got = feeds.merged_by_keyed_state(spark, thirds(spark, docs), 10_000, slices=3)
    assert model.spark_rows(got) == model.rows_of(expected)
    spread = doc(91, [{"id": f"i{k}", **NEW} for k in range(9)], [], "p1")
    with pytest.raises(Exception, match="several slices of project p1"):
        feeds.merged_by_keyed_state(spark, [model.spark_documents(spark, [spread])], 10_000, slices=3)
