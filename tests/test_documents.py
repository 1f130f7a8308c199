import json

import pytest
from pyspark.sql import functions as F

import model
from taskfold.operators import changelog, inventory
from taskfold.schema import FEATURE, PROJECT
from taskfold.sources import documents, listings, snapshots

FULL = {"id": "door", "name": "Front Door", "domain": "access", "description": "Opens at nine"}


def texts(spark, *docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "json string")


def test_parse_full_and_sparse(spark):
    docs = texts(spark, {"features": [FULL, {"id": "door", "status": "Complete", "extra": {"id": 1}}], "other": 5}, {})
    parsed = documents.parse_documents(docs).collect()
    first, second = parsed[0].features
    assert first.id == "door" and first.name == "Front Door" and first.tags is None
    assert second.name is None and second.status == "Complete"
    assert parsed[1].features == [] and parsed[1].remove_features == []


@pytest.mark.parametrize("bad", ['{"features": [', "   ", "nope"])
def test_bad_text_fails(spark, bad):
    with pytest.raises(Exception):
        documents.parse_documents(texts(spark, bad)).collect()


def test_errors(spark):
    cases = {
        '{"features": []}': None, "{}": None, json.dumps({"features": [FULL]}): None, '{"remove_features": ["x"]}': None,
        " ": "blank input", "[]": "malformed document", '{"features"': "malformed document", '"x"': "malformed document",
        '{"features": null}': "null list", '{"remove_features": null}': "null list", '{"features": [{}]}': "change without id",
        '{"features": [{"id": "a", "status": "complete"}]}': "unknown status",
        '{"features": [{"id": "a", "tags": null, "context": null}]}': None, '{"remove_features": [null]}': "change without id",
    }
    cases |= {
        '{"features": []} trailing': "malformed document", '{}{}': "malformed document", '{}],[{}': "malformed document",
        '{"features": [], "features": []}': "malformed document", '{"features": {}}': "wrong type", '{"features": [1]}': "wrong type",
        '{"features": [{"id": 1}]}': "wrong type", '{"remove_features": [1]}': "wrong type", '{"remove_features": "x"}': "wrong type",
        '{"features": [{"id": "a", "tags": "x"}]}': "wrong type", '{"features": [{"id": "a", "tags": ["x", 1]}]}': "wrong type",
        '{"features": [{"id": "a", "tags": ["x", null]}]}': "wrong type", '{"features": [{"id": "a", "files_involved": [], "tags": ["x"]}]}': None,
        '{"features": [{"id": "a", "description": {}}]}': "wrong type", '{"batch_seq": "1"}': "wrong type", '{"features": [null]}': "change without id",
    }
    got = {r.json: r.error for r in documents.document_errors(texts(spark, *cases)).collect()}
    assert got == cases


def test_parse_refuses_what_the_check_refuses(spark):
    for bad in ('{"features": null}', '{} x', '{"features": [{"id": 1}]}', '{"features": [{"id": "a", "tags": "x"}]}', "[{}, {}]", ""):
        with pytest.raises(Exception, match="invalid document"):
            documents.parse_documents(texts(spark, bad)).collect()


def test_stamped(spark):
    plain = documents.parse_documents(texts(spark, {"features": [FULL]}, {"features": [{"id": "door", "status": "Complete"}]}).selectExpr("json", "length(json) AS arrival"))
    docs = documents.stamped(plain, "p", 77, 5)
    assert sorted((r.project_id, r.batch_seq, r.batch_ts) for r in docs.collect()) == [("p", 5, 77), ("p", 6, 77)]
    assert documents.repeated_numbers(docs).isEmpty() and documents.repeated_numbers(docs.union(docs)).count() == 2


def test_flatten(spark):
    docs = model.spark_documents(spark, [{"project_id": "p", "batch_seq": 4, "batch_ts": 9,
                                          "features": [FULL, {"id": "b", "tags": []}], "remove_features": ["c", "c"]}])
    rows = documents.flatten_documents(docs).orderBy("op_rank", "pos").collect()
    assert [(r.op_rank, r.pos, r.id, r.name, r.tags) for r in rows] == [
        (0, 0, "door", "Front Door", None), (0, 1, "b", None, []), (1, 0, "c", None, None), (1, 1, "c", None, None)]
    assert {(r.project_id, r.batch_seq, r.batch_ts) for r in rows} == {("p", 4, 9)}


def test_read_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"project_id": "p", "batch_seq": 1, "batch_ts": 2, "features": [FULL]}, indent=2))
    assert documents.read_documents(spark, str(tmp_path)).first().features[0].id == "door"
    (tmp_path / "b.json").write_text('{"features": [')
    with pytest.raises(Exception):
        documents.read_documents(spark, str(tmp_path)).collect()


@pytest.fixture(scope="module")
def registry(spark):
    docs = [{"project_id": p, "batch_seq": b, "batch_ts": b, "remove_features": [],
             "features": [{**FULL, "id": f"i{b}-{k}", "tags": ['q"t', "ü"]} for k in range(5)]} for p in "pq" for b in range(1, 4)]
    log = documents.flatten_documents(model.spark_documents(spark, docs))
    return changelog.replay(spark.createDataFrame([], FEATURE), log, 3).cache()


@pytest.fixture(scope="module")
def projects(spark):
    return spark.createDataFrame([("p", "P", 1, 3), ("q", "Q", 1, 3), ("none", "None", 1, 1)], PROJECT)


def test_state_documents(registry, projects):
    got = {r.project_id: json.loads(r.json) for r in documents.state_documents(registry, projects).collect()}
    assert list(got["p"]) == ["project_name", "features", "created_at", "last_updated"]
    assert [f["id"] for f in got["p"]["features"]] == [f"i{b}-{k}" for b in range(1, 4) for k in range(5)]
    assert list(got["p"]["features"][0]) == ["id", "name", "domain", "tags", "status", "description", "context",
                                             "files_involved", "created_at", "last_updated", "recency_score"]
    assert got["p"]["features"][0]["context"] is None and got["p"]["features"][0]["tags"] == ['q"t', "ü"]
    assert got["none"] == {"project_name": "None", "features": [], "created_at": 1, "last_updated": 1}


@pytest.mark.parametrize("min_heavy_rows", [10**9, 4])
def test_state_documents_in_parts(registry, projects, min_heavy_rows):
    rows = documents.state_documents(registry, projects, 4, min_heavy_rows).orderBy("project_id", "part").collect()
    parts = [[f["id"] for f in json.loads(r.json)["features"]] for r in rows if r.project_id == "q"]
    assert [len(p) for p in parts] == [4, 4, 4, 3]
    assert [(json.loads(r.json)["part"], json.loads(r.json)["parts"]) for r in rows if r.project_id == "q"] == [(i, 4) for i in range(4)]
    assert sum(parts, []) == [f"i{b}-{k}" for b in range(1, 4) for k in range(5)]


def test_json_rows(spark, registry, tmp_path):
    path = str(tmp_path / "out")
    documents.write_json_rows(registry, path)
    assert '"context":null' in spark.read.text(path).first()[0]
    assert spark.read.schema(FEATURE).json(path).exceptAll(registry).isEmpty()
    assert json.loads(documents.feature_json(registry).first().json)["context"] is None


def test_snapshots(spark, registry, tmp_path):
    root = str(tmp_path / "reg")
    with pytest.raises(FileNotFoundError, match="not initialized"):
        snapshots.load_snapshot(spark, root)
    assert snapshots.create_registry(spark, root) and not snapshots.create_registry(spark, root)
    assert snapshots.load_snapshot(spark, root).count() == 0
    snapshots.save_snapshot(registry, root, 1, cluster=True)
    stored = snapshots.load_snapshot(spark, root)
    assert stored.drop("domain_lc").exceptAll(registry).isEmpty() and stored.count() == registry.count()
    assert snapshots.load_snapshot(spark, root, 0).count() == 0
    (tmp_path / "reg" / "v=2").mkdir()  # a write that never finished
    assert snapshots.latest_version(spark, root) == 1


def test_duplicates_are_rejected(registry):
    assert snapshots.reject_duplicates(registry) is registry
    with pytest.raises(ValueError, match="stored 2 times"):
        snapshots.reject_duplicates(registry.union(registry))


def test_uniqueness_is_found_out_when_saving(spark, registry, tmp_path, monkeypatch):
    root = str(tmp_path)
    with pytest.raises(ValueError, match="stored 2 times"):
        snapshots.save_snapshot(registry.union(registry), root, 1)
    assert snapshots.latest_version(spark, root) is None
    snapshots.save_snapshot(registry, root, 1)
    registry.union(registry).write.parquet(f"{root}/v=2")  # by someone else, so it has no mark
    with pytest.raises(ValueError, match="stored 2 times"):
        snapshots.load_snapshot(spark, root)
    monkeypatch.setattr(snapshots, "reject_duplicates", lambda rows: pytest.fail("counted again"))
    assert snapshots.load_snapshot(spark, root, 1).count() == registry.count()


def test_add_projects(spark, projects):
    ids = spark.createDataFrame([("p",), ("new",), ("new",)], "project_id string")
    got = {r.project_id: (r.project_name, r.created_at) for r in snapshots.add_projects(projects, ids, 50).collect()}
    assert got["new"] == ("My Project", 50) and got["p"] == ("P", 1) and len(got) == 4


def test_listing_of_folder(spark, tmp_path):
    (tmp_path / "src" / "a").mkdir(parents=True)
    (tmp_path / "src" / "a" / "x.rs").write_text("1")
    (tmp_path / "top.md").write_text("1")
    got = listings.listing_of_folder(spark, "p", str(tmp_path)).collect()
    assert sorted((r.project_id, r.path) for r in got) == [("p", "src/a/x.rs"), ("p", "top.md")]
    listings.listing_of_folder(spark, "p", str(tmp_path)).write.parquet(str(tmp_path / "m"))
    assert listings.read_listing(spark, str(tmp_path / "m")).count() == 2


def test_stamped_in_ranges(spark):
    """All documents get their numbers without going into one task."""
    plain = spark.range(3000, numPartitions=5).selectExpr("(id * 7919) % 3001 AS arrival", "concat('{\"features\": [{\"id\": \"', (id * 7919) % 3001, '\"}]}') AS json")
    docs = documents.stamped(documents.parse_documents(plain), "p", 77, 5)
    assert "SinglePartition" not in docs._jdf.queryExecution().executedPlan().toString()
    arrivals = sorted(r["arrival"] for r in plain.collect())
    got = sorted((r["batch_seq"], int(r["features"][0]["id"])) for r in docs.collect())
    assert got == [(5 + i, a) for i, a in enumerate(arrivals)]


@pytest.fixture
def no_broadcasts(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def aggregate_inputs(plan):
    """The partitioning of the exchange below each nesting aggregate of a plan."""
    lines = plan._jdf.queryExecution().executedPlan().toString().split("\n")
    out = []
    for i, line in enumerate(lines):
        if "ObjectHashAggregate" in line and "functions=[collect_list" in line:
            out.append(next(x for x in lines[i + 1 :] if "Exchange hashpartitioning" in x))
    return out


def test_nested_documents_are_dealt_by_project_and_part(spark, registry, projects, no_broadcasts, tmp_path):
    """With all broadcasts off, items meet in an exchange by project and part, and headers come after it."""
    registry.write.parquet(str(tmp_path / "items"))
    plan = documents.state_documents(spark.read.parquet(str(tmp_path / "items")), projects, 4)
    below = aggregate_inputs(plan)
    assert below and all("hashpartitioning(project_id#" in x and ", part#" in x for x in below)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.index("LeftOuter") < text.index("functions=[collect_list")  # the last join lies above the nesting


def test_report_files_are_dealt_by_slice(spark, no_broadcasts, tmp_path):
    paths = [(f"p{i % 2}", f"src/d{i % 3}/f{i}.py") for i in range(60)]
    spark.createDataFrame(paths, "project_id string, path string").write.parquet(str(tmp_path / "paths"))
    plan = inventory.report_documents(spark.read.parquet(str(tmp_path / "paths")), 10)
    below = aggregate_inputs(plan)
    assert any("_slice#" in x for x in below) and all("_slice#" in x or ", part#" in x for x in below)
    docs = [json.loads(r.json) for r in plan.collect()]
    found = sorted((d["root"], s["suggested_id"], f) for d in docs for s in d["potential_features"] for f in s["files"])
    assert found == sorted((p, path.split("/")[1], path) for p, path in paths)


def test_texts_as_written_and_others_have_equal_errors(spark):
    changes = ['{"id":"a"}', '{"id":"a","status":"Pending","tags":["x"]}', '{"id":"a","tags":[null]}', '{"name":"a"}', '{"id":"a","status":"done"}', "null"]
    plain = ["{}"] + [f'{{"project_id":"p","batch_seq":1,"batch_ts":2,"features":[{c}],"remove_features":[{r}]}}' for c in changes for r in ('"b"', "null")]
    plain += ['{"project_id":"p","batch_seq":1.0}', '{"project_id":5}', '{"project_id":"p","project_id":"p"}', '{"features":null}', "{}{}", ""]
    rows = [(i, t) for i, text in enumerate(plain) for t in (text, text.replace(",", " , ") if text else " ")]
    found = {}
    for r in documents.checked_documents(spark.createDataFrame(rows, "i int, json string")).withColumn(
        "error", F.coalesce("error", documents.change_error(F.col("features"), F.col("remove_features")))
    ).collect():
        found.setdefault(r.i, []).append((r.error, r.project_id, r.features, r.remove_features))
    assert all(a == b for a, b in found.values())
    again = documents.document_errors(spark.createDataFrame(rows, "i int, json string")).select("i", "error").distinct().collect()
    assert dict(again) == {i: e[0][0] for i, e in found.items()} and len(set(dict(again).values())) == 7


def test_plain_texts_need_no_tree(spark):
    texts = spark.createDataFrame([('{"project_id":"p"}',), ('{"project_id": "p"}',)], "json string")
    plan = documents.checked_documents(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "_plain" in plan and "CASE WHEN NOT _plain" in plan
