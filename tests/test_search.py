import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from taskfold import fixed
from taskfold.operators import many_search, report, search
from taskfold.plans import catalog, oracle, standins
from taskfold.schema import FEATURE, SEARCH_QUERY


def item(id, name="N", domain="d", description="D", tags=("backend",), status="Pending", context=None, pos=0, project="p"):
    return (project, id, name, domain, list(tags), status, description, context, [], 0, 0, 1.0, 0, pos)


ALPHABET = ["a", "b", "C", "%", "_", "\\", ".", " ", "é"]


def texts(rnd, longest):
    return "".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(1, longest)))


def random_items(seed, n=60):
    rnd = random.Random(seed)
    return [
        item(texts(rnd, 5) + str(i), texts(rnd, 9), rnd.choice(["Xa", "xA", "y_", "q%"]), texts(rnd, 25),
             [texts(rnd, 3) for _ in range(rnd.randrange(3))], rnd.choice(fixed.STATUSES), rnd.choice([None, texts(rnd, 9)]), rnd.randrange(10**6))
        for i in range(n)
    ]


ITEMS = random_items(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, FEATURE)


def ids(df):
    return [r.id for r in search.in_stored_order(df).collect()]


def in_order(rows):
    return [r[1] for r in sorted(rows, key=lambda r: (r[12], r[13]))]


def random_filters(seed, n=40):
    rnd = random.Random(seed)
    for _ in range(n):
        whole = rnd.choice(ITEMS)
        of = {
            "keyword": rnd.choice(["", texts(rnd, 4), whole[6][1:4].swapcase(), whole[1][-2:], [texts(rnd, 2), texts(rnd, 2)]]),
            "domain": rnd.choice([whole[3].upper(), "x", "none"]),
            "tag": rnd.choice([*whole[4], "a", "B", ""]).swapcase(),
            "status": rnd.choice([whole[5].lower(), whole[5].upper(), "in progress"]),
        }
        yield {k: of[k] for k in rnd.sample(sorted(of), rnd.randrange(1, 4))}


@pytest.mark.parametrize("seed", range(2))
def test_search(items, seed):
    """Random filters, one after another, against the same filters in plain Python."""
    hits = 0
    for filters in random_filters(seed):
        word = filters.get("keyword")
        query = (0, " ".join(word) if isinstance(word, list) else word, *[filters.get(k) for k in ("domain", "tag", "status")])
        expected = in_order([f for f in ITEMS if matches(query, f)])
        assert ids(search.search(items, **filters)) == expected, filters
        hits += len(expected)
    assert hits > 100


def test_a_filter_is_needed(items):
    with pytest.raises(ValueError):
        search.search(items)


def test_counts_and_lookup(items):
    found = [f for f in ITEMS if matches((0, "a", None, None, None), f)]
    assert search.count_matches(items, keyword="a").first().n_matches == len(found) > 0
    assert ids(search.lookup(items, "p", ITEMS[7][1])) == [ITEMS[7][1]]
    assert ids(search.lookup(items, "p", "nope")) == []
    keys = items.filter("status = 'Blocked'").union(items.filter("status = 'Blocked'"))
    assert ids(search.lookup_many(items, keys)) == in_order([f for f in ITEMS if f[5] == "Blocked"])


def test_literal_filters_reach_the_scan(spark, items, tmp_path):
    path = str(tmp_path / "f")
    items.withColumn("domain_lc", F.lower("domain")).write.parquet(path)
    found = search.search(spark.read.parquet(path), status="complete", domain="A_B").select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,Complete)" in plan and "EqualTo(domain_lc,a_b)" in plan
    assert "description" not in plan


def matches(q, f):
    texts = [f[1], f[2], f[3], f[6], f[7], *f[4]]
    ok = q[1] is None or any(t is not None and q[1].lower() in t.lower() for t in texts)
    ok &= q[2] is None or q[2].lower() == f[3].lower()
    ok &= q[3] is None or q[3].lower() in [t.lower() for t in f[4]]
    return ok and (q[4] is None or q[4].lower() == f[5].lower())


def brute(items, queries):
    return sorted((q[0], f[0], f[1]) for q in queries for f in items if matches(q, f))


@pytest.mark.parametrize("seed", [0, 10])
def test_many_queries(spark, seed):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abAB_%. é") for _ in range(n))
    rows = [
        item(f"i{i}", word(5), rnd.choice(["x", "Y", "hot"]), word(60), [word(2) for _ in range(i % 3)],
             rnd.choice(["Pending", "Complete"]), None if i % 2 else word(9), i, f"p{i % 2}")
        for i in range(80)
    ]
    maybe = lambda v, p: v if rnd.random() < p else None
    asked = []
    for i in range(120):
        q = (i, maybe(word(rnd.choice([0, 1, 2, 3, 4])), 0.6), maybe(rnd.choice(["X", "hot", "q"]), 0.3),
             maybe(word(2), 0.2), maybe(rnd.choice(["pending", "nope"]), 0.3))
        asked.append(q if any(v is not None for v in q[1:]) else (i, "a", None, None, None))
    asked += [(500, "a\u0000b", None, None, None), (501, "", None, None, None)]
    for kept in (None, 0):
        got = many_search.search_many(spark.createDataFrame(rows, FEATURE), spark.createDataFrame(asked, SEARCH_QUERY), kept)
        assert sorted((r.query_id, r.project_id, r.id) for r in got.collect()) == brute(rows, asked)


def test_only_grams_asked_for_leave_the_row(spark, items):
    """The texts are exploded after they were reduced to the grams of the words, and are not shuffled."""
    queries = spark.createDataFrame([(1, "abc", None, None, None), (2, "b_C", None, None, None)], SEARCH_QUERY)
    plan = many_search.search_many(items, queries)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(_grams" in plan and "Join" not in plan.split("Generate explode(_grams")[1].split("LogicalRDD")[0]


def test_many_queries_need_a_filter(spark, items):
    empty = spark.createDataFrame([(1, None, None, None, None)], SEARCH_QUERY)
    with pytest.raises(Exception, match="query 1 has no filter"):
        many_search.search_many(items, empty).collect()


def test_many_queries_never_compare_all_pairs(spark, items):
    queries = spark.createDataFrame([(1, "a", None, None, None), (2, None, "d", None, None)], SEARCH_QUERY)
    plan = many_search.search_many(items, queries)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("NestedLoop", "Cartesian", "Python", "Pandas", "Arrow"))


def test_many_queries_on_items_without_tags(spark):
    rows = [f if i % 3 else (*f[:4], [], *f[5:]) for i, f in enumerate(ITEMS)]
    bare = spark.createDataFrame([f if i % 3 else (*f[:4], None, *f[5:]) for i, f in enumerate(ITEMS)], FEATURE)
    asked = [(1, None, "xa", None, None), (2, "a", None, None, None), (3, "b", "y_", "a", None)]
    got = many_search.search_many(bare, spark.createDataFrame(asked, SEARCH_QUERY)).collect()
    assert sorted((r.query_id, r.project_id, r.id) for r in got) == brute(rows, asked)


def test_report(spark):
    rows = [item(f"id-{i:02d}-{'x' * (i * 5)}", pos=i, domain="a-very-long-domain-name") for i in range(5)]
    scored = spark.createDataFrame(rows, FEATURE).withColumn(
        "recency_score", F.when(F.col("ord_pos") == 3, 0.9).when(F.col("ord_pos") == 1, 0.2).otherwise(0.5)
    )
    expected = [3, 0, 2, 4, 1]  # equal scores keep the stored order
    assert [r.ord_pos for r in report.ranked(scored).orderBy("rank").collect()] == expected
    assert [r.ord_pos for r in report.ranked(scored, min_heavy_rows=1).orderBy("rank").collect()] == expected
    assert [r.ord_pos for r in report.sorted_by_recency(scored).collect()] == expected
    assert [r.ord_pos for r in report.top_by_recency(scored, 2).collect()] == expected[:2]
    assert [r.ord_pos for r in report.top_by_recency_per_project(scored, 3).orderBy("rank").collect()] == expected[:3]
    shown = report.report_rows(report.ranked(scored)).orderBy("rank").collect()
    assert [r.recency for r in shown] == ["90%", "50%", "50%", "50%", "20%"]
    assert {r.domain for r in shown} == {"a-very-long.."} and all(len(r.id) <= 19 for r in shown)


def test_top_k_is_cut_before_the_shuffle(items):
    plan = report.top_by_recency_per_project(items, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    plan = report.top_by_recency(items, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_completion(spark, items):
    projects = spark.createDataFrame([("p",), ("void",)], "project_id string")
    got = {r.project_id: r.label for r in report.completion_summary(items, projects).collect()}
    done = sum(f[5] == "Complete" for f in ITEMS)
    assert got == {"p": f"{done}/{len(ITEMS)}", "void": "0/0"} and done
    assert report.feature_counts(items).first().n_features == len(ITEMS)


def test_every_label_asks(spark):
    """Query and SQL ask for all labels, those with a number not divisible by 100 as well."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    labels = [r.doc_id for r in standins.table(spark, folder, "labels").select("doc_id").collect()]
    asked = [r.query_id for r in standins.search_queries(spark, folder).select("query_id").collect()]
    assert sorted(asked) == sorted(labels) and any(i % 100 for i in asked)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    found = catalog.search_many_queries(spark, folder).select("query_id", "project_id", "id").collect()
    theirs = con.sql(oracle.statements()["search_many_queries"]).project("query_id, project_id, id").fetchall()
    assert sorted(map(tuple, found)) == sorted(theirs) and any(r.query_id % 100 for r in found)


@pytest.mark.parametrize("n", [1, 256, 769])
def test_queries_of_one_key_in_blocks(spark, n):
    rows = [item(f"i{i}", domain=["hot", "x"][i % 2], pos=i) for i in range(7)]
    asked = [(i, None, "hot", None, None) for i in range(n)] + [(-1, None, "x", None, "Pending"), (-2, None, "none", None, None)]
    many = spark.createDataFrame(asked, SEARCH_QUERY)
    got = many_search.search_many(spark.createDataFrame(rows, FEATURE), many)
    assert sorted((r.query_id, r.project_id, r.id) for r in got.collect()) == brute(rows, asked)


def test_only_grams_of_asked_letters_leave_a_row(spark):
    grams = spark.createDataFrame([("a-1",), ("é-2",), ("x",)], "gram string")
    letters = many_search._letters(grams)
    assert letters == {(3, 0, "a"), (3, 0, "é"), (3, 1, "-"), (3, 2, "1"), (3, 2, "2"), (1, 0, "x")}
    text = spark.createDataFrame([("a-1 a-2 b-1 éé-1x",)], "text string")
    assert text.select(many_search._grams_like(F.col("text"), letters)).first()[0] == ["a-1", "a-2", "é-1", "x"]
    many = spark.createDataFrame([(chr(0x4E00 + i) + "b",) for i in range(300)], "gram string").selectExpr("concat(gram, 'c') AS gram")
    letters = many_search._letters(many)
    assert text.select(many_search._grams_like(F.lit("\u4e01bc \u4fffbc Abd"), letters)).first()[0] == ["\u4e01bc", "\u4fffbc"]


@pytest.mark.parametrize("kept", [None, 0])
def test_words_of_all_lengths(spark, kept):
    rnd = random.Random(5)
    rows = [item(f"i{i}", texts(rnd, 9), description=texts(rnd, 60) + "\U0001f600éa" * (i % 3 == 0) + texts(rnd, 30), pos=i) for i in range(60)]
    asked = []
    for n in (1, 2, 3, 5, 6, 7, 11, 12, 13, 20):
        for f in rnd.sample(rows, 12):
            at = rnd.randrange(max(1, len(f[6]) - n))
            asked.append((len(asked), f[6][at : at + n], None, None, None))
    asked.append((len(asked), "\U0001f600éa", None, None, None))
    got = many_search.search_many(spark.createDataFrame(rows, FEATURE), spark.createDataFrame(asked, SEARCH_QUERY), kept)
    assert sorted((r.query_id, r.project_id, r.id) for r in got.collect()) == brute(rows, asked)


def test_many_long_words_meet_few_items(spark, monkeypatch):
    """What grams alone bring together grows with the matches, not with words times items."""
    monkeypatch.setattr(many_search, "keyword_predicate", lambda word: F.lit(True))
    items = spark.createDataFrame([item(f"i{i}", f"note {i}", pos=i) for i in range(10_000, 30_000, 7)], FEATURE)
    words = items.select(F.col("name").alias("word"))
    assert words.count() <= many_search.hits_by_gram(items, words, kept_words=0).count() < 2 * words.count()


@pytest.mark.parametrize("kept_keys", [100, 2])
def test_blocks_of_items_and_queries(spark, monkeypatch, kept_keys):
    monkeypatch.setattr(many_search, "BLOCK", 4)
    monkeypatch.setattr(many_search, "KEPT_KEYS", kept_keys, raising=False)
    rows = [item(f"i{i}", domain=["hot", "x", "alone"][i % 3 if i else 2], tags=["t", "t", "u"], pos=i, project=f"p{i % 4}") for i in range(50)]
    asked = [(i, None, ["hot", "x", "none"][i % 3], [None, "t", "u"][i % 7 % 3], None) for i in range(60)]
    got = many_search.search_many(spark.createDataFrame(rows, FEATURE), spark.createDataFrame(asked, SEARCH_QUERY))
    assert sorted((r.query_id, r.project_id, r.id) for r in got.collect()) == brute(rows, asked)
