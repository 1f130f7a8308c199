import numpy as np
import pytest

from taskfold.operators import housekeeping, similarity
from taskfold.schema import FEATURE


def item(id, files=(), status="Pending", tags=(), domain="d", description="x", updated=0, project="p"):
    return (project, id, "n", domain, list(tags), status, description, None, list(files), 0, updated, 1.0, 0, 0)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [item("a", ["f", "g", "f"], tags=["t", "t", "u"]), item("b", ["f"], "Complete", ["t"], updated=100 * 86400),
         item("c", (), domain="e", description="y" * 3000), item("a", ["f"], project="q")], FEATURE).cache()


def test_index(items):
    got = {(r.project_id, r.file): r.ids for r in housekeeping.file_index(items).collect()}
    assert got == {("p", "f"): ["a", "b"], ("p", "g"): ["a"], ("q", "f"): ["a"]}
    parts = housekeeping.file_index(items, ids_per_row=1, min_heavy_rows=1).filter("project_id = 'p' and file = 'f'").collect()
    assert sorted((r.part, r.ids) for r in parts) == [(0, ["a"]), (1, ["b"])]


def test_facets(items):
    got = {(r.project_id, r.facet, r.value): r.n_features for r in housekeeping.facets(items).collect()}
    assert got["p", "status", "Pending"] == 2 and got["p", "tag", "t"] == 2 and got["p", "domain", "d"] == 2
    assert got["q", "status", "Pending"] == 1


def test_archive_border(items):
    live, old = housekeeping.split_archive(items, 190 * 86400)
    assert [r.id for r in live.collect()] == ["b"] and old.count() == 3  # exactly 90 days is not older


def test_stale_files(spark, items):
    listing = spark.createDataFrame([("p", "f"), ("q", "g")], "project_id string, path string")
    got = {(r.project_id, r.id): r.files_involved for r in housekeeping.drop_stale_files(items, listing).collect()}
    assert got == {("p", "a"): ["f", "f"], ("p", "b"): ["f"], ("p", "c"): [], ("q", "a"): []}


def test_small(items):
    assert housekeeping.distinct_files(items).filter("project_id = 'p' and id = 'a'").first().files_involved == ["f", "g"]
    assert max(len(r.description) for r in housekeeping.shorten_descriptions(items).collect()) == 2048


def test_audit(items):
    got = {r.project_id: (r.n_features, r.n_files, r.max_path, r.max_description, r.over_limit) for r in housekeeping.limit_audit(items).collect()}
    assert got == {"p": (3, 2, 1, 3000, True), "q": (1, 1, 1, 1, False)}


def test_attention(spark):
    visits = spark.createDataFrame([("p", "a", "f"), ("p", "a", "f"), ("p", "b", "f")], "project_id string, feature_id string, target string")
    assert {(r.feature_id, r.n_visits) for r in housekeeping.attention_map(visits).collect()} == {("a", 2), ("b", 1)}


def test_nearest(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 2.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (5, [3.0, 0.0])], "id long, embedding array<float>")
    got = similarity.nearest(df, [1, 0], 3).collect()
    assert [r.id for r in got] == [1, 5, 2] and got[2].similarity == pytest.approx(0.5**0.5)


def clustered(n, size=16, seed=5):
    rnd = np.random.default_rng(seed)
    middles = rnd.normal(size=(12, size))
    return [(middles[i % 12] + rnd.normal(size=size) * 0.4).tolist() for i in range(n)]


def best(vectors, facets, queries, k):
    x = np.array([v / np.linalg.norm(v) for v in np.array(vectors)])
    out = {}
    for q, v, facet in queries:
        s = x @ (np.array(v) / np.linalg.norm(v))
        order = sorted((i for i in range(len(x)) if facet is None or facets[i] == facet), key=lambda i: (-s[i], i))
        out[q] = order[:k]
    return out


def test_nearest_many(spark):
    """All cells: equal to brute force, also where cells are cut into small blocks. Few cells: recall by facet."""
    vectors = clustered(900)
    facets = [str(i * 7 % 5) for i in range(900)]
    odd = [(1000, "1", None), (1001, "1", [0.0] * 16), (1002, "1", [float("nan")] * 16), (1003, "1", [1.0]), (1004, None, vectors[0])]
    items = spark.createDataFrame([(i, f, v) for i, (f, v) in enumerate(zip(facets, vectors))] + odd, "id long, f string, embedding array<double>")
    queries = [(100 + q, v, str(q % 5) if q % 2 else None) for q, v in enumerate(clustered(40, seed=6))] + [(900, [0.0] * 16, None), (901, vectors[3], "none")]
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>, facet string")
    facets, vectors = facets + [None], vectors + [vectors[0]]
    wanted = best(vectors, facets, queries[:40], 7)
    wanted = {q: [1004 if i == 900 else i for i in own] for q, own in wanted.items()}

    def found(index, probes=None):
        out = {}
        for r in sorted(similarity.nearest_many(index, asked, 7, probes).collect(), key=lambda r: (r.query_id, r.rank)):
            out.setdefault(r.query_id, []).append(r.id)
        return out

    assert found(similarity.index_vectors(items, facet="f", block_rows=25)) == wanted
    few = found(similarity.index_vectors(items, facet="f", cells=24), 6)
    share = sum(len(set(wanted[q]) & set(few.get(q, []))) for q in wanted) / sum(map(len, wanted.values()))
    assert share >= 0.95, share
    assert similarity.nearest_many(similarity.index_vectors(items.limit(0), facet="f"), asked, 3).collect() == []
