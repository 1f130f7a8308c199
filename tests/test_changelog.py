import pytest
from pyspark.sql import functions as F

import model
from taskfold.operators import changelog, lenient
from taskfold.schema import FEATURE
from taskfold.sources.documents import flatten_documents

NEW = {"name": "N", "domain": "d", "description": "D"}


def doc(batch, features=(), removed=(), project="p"):
    return {"project_id": project, "batch_seq": batch, "batch_ts": 100 * batch, "features": list(features), "remove_features": list(removed)}


def log_of(spark, docs):
    return flatten_documents(model.spark_documents(spark, docs))


def empty(spark):
    return spark.createDataFrame([], FEATURE)


def state(spark, docs, base=None, **options):
    return changelog.replay(empty(spark) if base is None else base, log_of(spark, docs), 10_000, **options)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_create_takes_defaults(spark):
    f = one(state(spark, [doc(1, [{"id": "a", **NEW}])]))
    assert (f.status, f.tags, f.context, f.files_involved) == ("Pending", [], None, [])
    assert (f.created_at, f.last_updated, f.ord_batch, f.ord_pos) == (100, 100, 1, 0)


def test_patch_keeps_what_is_not_provided(spark):
    first = {"id": "a", **NEW, "tags": ["x", "x"], "context": "why", "files_involved": ["f"]}
    f = one(state(spark, [doc(1, [first]), doc(2, [{"id": "a", "status": "Complete", "tags": None, "context": None}])]))
    assert (f.name, f.status, f.tags, f.context, f.files_involved) == ("N", "Complete", ["x", "x"], "why", ["f"])
    assert (f.created_at, f.last_updated) == (100, 200)


def test_id_alone_moves_the_clock(spark):
    assert one(state(spark, [doc(1, [{"id": "a", **NEW}]), doc(5, [{"id": "a"}])])).last_updated == 500


def test_lists_are_replaced_and_can_be_emptied(spark):
    docs = [doc(1, [{"id": "a", **NEW, "tags": ["x", "y"]}]), doc(2, [{"id": "a", "tags": ["z"]}])]
    assert one(state(spark, docs)).tags == ["z"]
    assert one(state(spark, [*docs, doc(3, [{"id": "a", "tags": []}])])).tags == []


def test_same_id_twice_in_one_document(spark):
    f = one(state(spark, [doc(1, [{"id": "a", **NEW}, {"id": "a", "name": "M", "status": "Blocked"}])]))
    assert (f.name, f.status, f.ord_pos) == ("M", "Blocked", 0)


def test_removals_come_after_upserts(spark):
    assert state(spark, [doc(1, [{"id": "a", **NEW}], ["a"])]).isEmpty()


def test_unknown_removal_is_ignored(spark):
    assert one(state(spark, [doc(1, [{"id": "a", **NEW}], ["zzz"])])).id == "a"


def test_new_generation_inherits_nothing(spark):
    docs = [doc(1, [{"id": "a", **NEW, "tags": ["x"], "context": "c"}, {"id": "b", **NEW}]), doc(2, [], ["a"]), doc(3, [{"id": "a", **NEW}])]
    got = state(spark, docs).orderBy("ord_batch", "ord_pos").collect()
    assert [f.id for f in got] == ["b", "a"]
    assert (got[1].tags, got[1].context, got[1].created_at) == ([], None, 300)


@pytest.mark.parametrize(
    "patch, field", [({}, "name"), ({"name": "N"}, "domain"), ({"name": "N", "domain": "d"}, "description"), ({"description": "D"}, "name")]
)
def test_creation_needs_its_fields(spark, patch, field):
    docs = [doc(1, [{"id": "ok", **NEW}]), doc(2, [{"id": "a", **patch}])]
    with pytest.raises(Exception, match=f"New feature 'a' requires '{field}' field"):
        state(spark, docs).collect()
    bad = one(changelog.first_bad_documents(log_of(spark, docs)))
    assert (bad.project_id, bad.batch_seq, bad.pos, bad.id, bad.field) == ("p", 2, 0, "a", field)
    assert one(changelog.invalid_creations(log_of(spark, docs))).field == field


def test_checked_even_if_removed_in_the_same_document(spark):
    with pytest.raises(Exception, match="requires 'name'"):
        state(spark, [doc(1, [{"id": "a"}], ["a"])]).collect()


def test_checked_after_a_removal_even_if_removed_again(spark):
    docs = [doc(1, [{"id": "a", **NEW}], ["a"]), doc(2, [{"id": "a"}], ["a"])]
    with pytest.raises(Exception, match="requires 'name'"):
        state(spark, docs).collect()


def test_known_items_need_no_fields(spark):
    base = state(spark, [doc(1, [{"id": "a", **NEW}])])
    f = one(state(spark, [doc(2, [{"id": "a", "status": "Blocked"}])], base))
    assert (f.status, f.name, f.created_at, f.ord_batch) == ("Blocked", "N", 100, 1)
    assert changelog.first_bad_documents(log_of(spark, [doc(2, [{"id": "a"}])]), base).isEmpty()
    assert one(changelog.first_bad_documents(log_of(spark, [doc(2, [{"id": "b"}])]), base)).id == "b"


def test_status_is_case_sensitive_on_write(spark):
    log = log_of(spark, [doc(1, [{"id": "a", **NEW, "status": "complete"}]), doc(2, [{"id": "b", **NEW, "status": "Complete"}])])
    assert one(changelog.bad_status_documents(log)).batch_seq == 1
    assert one(lenient.replay_lenient(empty(spark), log, 1000)).id == "b"
    with pytest.raises(Exception, match="unknown status"):
        changelog.replay(empty(spark), log, 1000).collect()


def test_scores_follow_the_clock(spark):
    docs = [doc(1, [{"id": "a", **NEW}]), doc(2, [{"id": "a", **NEW}], project="q")]
    by = {f.project_id: f.recency_score for f in state(spark, docs).collect()}
    assert by == {"p": pytest.approx(model.score(10_000, 100)), "q": pytest.approx(model.score(10_000, 200))}
    base = state(spark, docs)
    clock = changelog.project_clock(model.spark_documents(spark, [doc(9, project="q")]))
    merged = changelog.replay(base, log_of(spark, [doc(9, project="q")]), clock)
    by2 = {f.project_id: f.recency_score for f in merged.collect()}
    assert by2["p"] == by["p"] and by2["q"] == pytest.approx(model.score(900, 200))


def test_empty_document_touches_the_project(spark):
    projects = spark.createDataFrame([("p", "P", 1, 1), ("q", "Q", 1, 1)], "project_id string, project_name string, created_at long, last_updated long")
    got = changelog.touch_projects(projects, model.spark_documents(spark, [doc(3), doc(4)]))
    assert sorted((r.project_id, r.created_at, r.last_updated) for r in got.collect()) == [("p", 1, 400), ("q", 1, 1)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("min_heavy_rows", [10**9, 15])
def test_random_logs(spark, seed, min_heavy_rows):
    docs = model.valid_documents(seed, n_docs=60, n_ids=4)
    expected, _ = model.replay(docs)
    got = state(spark, docs, min_heavy_rows=min_heavy_rows)
    assert model.spark_rows(got) == model.rows_of(expected)


@pytest.mark.parametrize("seed", range(3))
def test_random_log_on_a_base(spark, seed):
    docs = model.valid_documents(seed + 50, n_docs=40)
    middle = [d["batch_seq"] for d in docs][len(docs) // 6]
    first, rest = [d for d in docs if d["batch_seq"] <= middle], [d for d in docs if d["batch_seq"] > middle]
    base, _ = model.replay(first)
    expected, _ = model.replay(rest, base)
    got = state(spark, rest, state(spark, first))
    assert model.spark_rows(got) == model.rows_of(expected)


@pytest.mark.parametrize("seed", range(3))
def test_first_bad_document(spark, seed):
    docs = model.random_documents(seed + 100, n_docs=30, p_bare=0.1)
    expected = {}
    for project in {d["project_id"] for d in docs}:
        mine = [d for d in docs if d["project_id"] == project]
        _, verdicts = model.replay(mine, lenient=True)
        bad = [b for (_, b), ok in verdicts.items() if not ok]
        if bad:
            expected[project] = min(bad)
    for rows in (10**9, 10):
        got = changelog.first_bad_documents(log_of(spark, docs), min_heavy_rows=rows).collect()
        assert {r.project_id: r.batch_seq for r in got} == expected


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("options", [{}, {"ranges": 1}, {"ranges": 3}, {"ranges": 40}])
def test_lenient_verdicts(spark, seed, options):
    docs = model.random_documents(seed, n_docs=40, p_bare=0.5)
    base_docs = model.valid_documents(seed + 900, n_docs=3, first=-9, n_ids=3)
    base, _ = model.replay(base_docs)
    _, expected = model.replay(docs, base, lenient=True)
    log = log_of(spark, docs).cache()
    got = lenient.document_verdicts(log, state(spark, base_docs), **options)
    with_rows = {(d["project_id"], d["batch_seq"]) for d in docs if d["features"] or d["remove_features"]}
    assert {(r.project_id, r.batch_seq): r.accepted for r in got.collect()} == {k: v for k, v in expected.items() if k in with_rows}


def test_lenient_replay(spark):
    docs = model.random_documents(77, n_docs=40)
    expected, verdicts = model.replay(docs, lenient=True)
    assert not all(verdicts.values())
    got = lenient.replay_lenient(empty(spark), log_of(spark, docs), 10_000)
    assert model.spark_rows(got) == model.rows_of(expected)


@pytest.mark.parametrize("starts", [True, False])
def test_a_chain_of_documents_takes_two_passes(spark, monkeypatch, starts):
    """Document k creates item k and needs item k - 1; another project removes what it made before."""
    n, written = 10_000, []
    none = [f"CAST(NULL AS {t}) AS {c}" for c, t in [("status", "STRING"), ("tags", "ARRAY<STRING>"), ("context", "STRING"), ("files_involved", "ARRAY<STRING>")]]

    def changes(project, item, pos=0, name="'N'", op=0, rows="true"):
        change = ["id AS batch_seq", "id AS batch_ts", f"{op} AS op_rank", f"{pos}L AS pos", f"{item} AS id", f"{name} AS name"]
        return spark.range(1, n + 1).filter(rows).selectExpr(f"'{project}' AS project_id", *change, "'d' AS domain", "'D' AS description", *none)

    chain = changes("p", "concat('i', id)").union(changes("p", "concat('i', id - 1)", 1, "CAST(NULL AS STRING)"))
    # item x comes in odd documents and goes in even ones, of which every fifth also needs y, which is never there
    turns = changes("q", "IF(id % 10 = 0, 'y', 'x')", name="IF(id % 2 = 1, 'N', NULL)").union(changes("q", "'x'", op=1, rows="id % 2 = 0"))
    log = chain.union(turns)
    base = state(spark, [doc(-1, [{"id": "i0", **NEW}] if starts else [])])
    keep = lenient.stored
    monkeypatch.setattr(lenient, "stored", lambda df, name: written.append(name) or keep(df, name))
    got = {(r.project_id, r.batch_seq): r.accepted for r in lenient.document_verdicts(log, base, ranges=7).collect()}
    assert len(written) == 2 and len(got) == 2 * n
    assert all(got["p", k] == starts for k in range(1, n + 1))
    assert all(got["q", k] == (k % 10 != 0) for k in range(1, n + 1))


def test_fold_document(spark):
    log = log_of(spark, [doc(1, [{"id": "a", **NEW}, {"id": "a", "name": "M", "tags": []}, {"id": "b", "tags": ["t"]}], ["b"])])
    got = {r.id: r for r in changelog.fold_document(log).collect()}
    assert (got["a"].name, got["a"].n_patches, got["a"].tags, got["a"].removed) == ("M", 2, [], False)
    assert (got["b"].tags, got["b"].removed) == (["t"], True)


def test_small_operations(spark):
    items = state(spark, [doc(1, [{"id": i, **NEW} for i in "abc"])]).cache()
    gone = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "zz")], "project_id string, id string")
    assert sorted(r.id for r in changelog.remove_features(items, gone).collect()) == ["b", "c"]
    twice = changelog.append_features(items, items.filter("id = 'a'"))
    assert twice.count() == 4 and one(changelog.duplicate_keys(twice)).id == "a"
    done = {r.id: (r.status, r.last_updated) for r in changelog.mark_complete(items, F.col("id") == "b", 777).collect()}
    assert done == {"a": ("Pending", 100), "b": ("Complete", 777), "c": ("Pending", 100)}
    touched = {r.id: r.last_updated for r in changelog.touch(items, F.col("id") == "c", 5).collect()}
    assert touched == {"a": 100, "b": 100, "c": 5}
    with pytest.raises(ValueError):
        changelog.set_status(items, F.lit(True), "done", 1)


def test_an_ordinary_log_is_shuffled_once(spark, tmp_path):
    """Window and aggregate share one exchange; the registry has the other."""
    log_of(spark, model.valid_documents(1)).write.parquet(str(tmp_path / "log"))
    plan = changelog.replay(empty(spark), spark.read.parquet(str(tmp_path / "log")), 1)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange ") == 2
