import json
import random
from collections import Counter, defaultdict

import pytest

from taskfold import fixed
from taskfold.operators import inventory
from taskfold.plans import catalog
from taskfold.schema import FILE_LISTING

SKIP = set(fixed.SKIP_DIRS)


def brute(paths):
    """Profile of one project, straight from the rules."""
    kept = [p for p in paths if not SKIP & set(p.split("/")[:-1])]
    ext = Counter()
    for p in kept:
        stem, dot, tail = p.split("/")[-1].rpartition(".")
        if dot and stem:
            ext[tail.lower()] += 1
    dirs = {p.split("/")[0] for p in paths if "/" in p}
    dirs = sorted(d for d in dirs if not d.startswith(".") and d not in SKIP)
    groups = defaultdict(list)
    for p in kept:
        parts = p.split("/")
        if len(parts) >= 3 and parts[0] in fixed.SOURCE_ROOTS and not parts[1].startswith("."):
            groups[parts[1], fixed.SOURCE_ROOTS.index(parts[0])].append(p)
    suggestions = [(k[0], sorted(v)) for k, v in sorted(groups.items()) if len(v) >= 2]
    return {"languages": dict(ext), "directories": dirs, "suggestions": suggestions, "total_files": len(kept)}


@pytest.fixture(scope="module")
def projects():
    rnd = random.Random(3)
    names = ["src", "lib", "app", "pkg", "docs", "target", ".github", "user_auth", "api-x", "bin", ".h", "db", "build"]
    files = ["a.rs", "B.RS", "c.tar.gz", "README", ".env", "x.", "build", "é.Md", "n.py"]
    out = {}
    for p in range(4):
        paths = {"/".join([*(rnd.choice(names) for _ in range(rnd.randrange(4))), f"{rnd.randrange(9)}{rnd.choice(files)}"]) for _ in range(300)}
        out[f"p{p}"] = sorted(paths)
    out["edge"] = ["README", ".gitignore", "a/.foo.bar", "foo.", "x.tar.gz", "build", "a/build/x.rs", "src/one/only.rs", "src/top.rs",
                   "src/bin/x.rs", "src/bin/y.rs", "src/auth/a.rs", "src/auth/deep/b.rs", "lib/auth/a.rs", "lib/auth/b.rs"]
    out["skipped"] = ["target/a.rs", "node_modules/b/c.js"]
    return out


@pytest.fixture(scope="module")
def listing(spark, projects):
    return spark.createDataFrame([(p, f) for p, fs in projects.items() for f in fs], FILE_LISTING).cache()


def test_profile(listing, projects):
    expected = {p: brute(fs) for p, fs in projects.items()}
    hist = defaultdict(dict)
    for r in inventory.extension_histogram(listing).collect():
        hist[r.project_id][r.ext] = r.n_files
    dirs = defaultdict(list)
    for r in inventory.top_directories(listing).collect():
        dirs[r.project_id].append(r.directory)
    files = defaultdict(list)
    for r in inventory.suggestion_files(listing).collect():
        files[r.project_id, r.suggested_id, fixed.SOURCE_ROOTS.index(r.source_root)].append(r.path)
    totals = {r.project_id: r.total_files for r in inventory.total_files(listing).collect()}
    counts = {r.project_id: r.n_suggestions for r in inventory.count_suggestions(listing).collect()}
    for p, e in expected.items():
        assert hist[p] == e["languages"]
        assert sorted(dirs[p]) == e["directories"]
        assert [(k[1], sorted(v)) for k, v in sorted(files.items()) if k[0] == p] == e["suggestions"]
        assert totals[p] == e["total_files"] and counts.get(p, 0) == len(e["suggestions"])


def test_suggestions_are_sorted_and_named(listing):
    rows = inventory.in_suggestion_order(inventory.suggested_features(listing).filter("project_id = 'edge'")).collect()
    assert [(r.suggested_id, r.source_root, r.suggested_name, r.suggested_domain, r.n_files) for r in rows] == [
        ("auth", "src", "Auth", "security", 2), ("auth", "lib", "Auth", "security", 2)
    ]


def test_whole_reports(listing, projects):
    docs = {r.project_id: json.loads(r.json) for r in inventory.report_documents(listing).collect()}
    assert set(docs) == set(projects)
    for p, fs in projects.items():
        e = brute(fs)
        assert list(docs[p]) == ["root", "languages", "directories", "potential_features", "total_files"]
        assert docs[p]["languages"] == e["languages"] and docs[p]["directories"] == e["directories"]
        assert [(s["suggested_id"], s["files"]) for s in docs[p]["potential_features"]] == e["suggestions"]
        assert docs[p]["total_files"] == e["total_files"] and docs[p]["root"] == p


def test_reports_in_parts_hold_everything(listing, projects):
    rows = inventory.report_documents(listing, entries_per_document=7).collect()
    assert len({(r.project_id, r.part) for r in rows}) == len(rows) > len(projects)
    for p, fs in projects.items():
        e = brute(fs)
        docs = [json.loads(r.json) for r in rows if r.project_id == p]
        assert {d["total_files"] for d in docs} == {e["total_files"]}
        assert {d.get("parts", 1) for d in docs} == {len(docs)} and {d.get("part", 0) for d in docs} == set(range(len(docs)))
        assert Counter(k for d in docs for k in d["languages"].items()) == Counter(e["languages"].items())
        assert sorted(x for d in docs for x in d["directories"]) == e["directories"]
        files = sorted(f for d in docs for s in d["potential_features"] for f in s["files"])
        assert files == sorted(f for _, fs in e["suggestions"] for f in fs)


@pytest.mark.parametrize("size, heavy", [(3, 10**6), (7, 10**6), (7, 4), (10**6, 10**6)])
def test_parts_put_together_are_the_whole_report(listing, projects, size, heavy):
    found = catalog._report_files(inventory.report_documents(listing, size, heavy)).collect()
    want = [
        (p, 0, place, item, at, path)
        for p, fs in projects.items()
        for place, (item, files) in enumerate(brute(fs)["suggestions"])
        for at, path in enumerate(files)
    ]
    assert sorted((r.project_id, r.part, r.place, r.suggested_id, r.file_place, r.path) for r in found) == sorted(want)


def test_summary(listing, projects):
    got = {r.project_id: r.summary for r in inventory.extension_summary(listing).collect()}
    assert got["skipped"] == "none detected"
    for p, fs in projects.items():
        top = sorted(brute(fs)["languages"].items(), key=lambda kv: (-kv[1], kv[0]))[:5]
        assert got[p] == (", ".join(f"{k} ({n})" for k, n in top) or "none detected")


def test_summary_keeps_a_nameless_extension(spark):
    df = spark.createDataFrame([("p", "foo.")], FILE_LISTING)
    assert inventory.extension_summary(df).first().summary == " (1)"
