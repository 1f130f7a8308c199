"""Toxicity: automata against edit distances, context, held-out accuracy."""

import random
import zlib

import pytest

from taskfold.llm import toxicity as tx


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow_find(terms, word):
    best = None
    for i, t in enumerate(terms):
        for part in [word[:n] for n in range(1, len(word))] if t.stem else [word]:
            if (d := distance(part, t.text)) <= t.edits:
                best = min(best or (99, 0), (d, i))
    return best


def test_matcher_against_edit_distance():
    rng = random.Random(5)
    terms = [tx.Term(w, s) for w, s in [("idiot", False), ("worthless", False), ("scum", False), ("idioma", True), ("lowei", True), ("clown", False), ("clowns", True), ("disgusting", False)]]
    for states in (50_000, 3):
        matcher = tx.Matcher(terms, max_states=states)
        for _ in range(4000):
            w = list(rng.choice(terms).text)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = rng.choice(["", "x", "i", "o", "ss"])
            w = "".join(w) or "a"
            assert matcher.find(w) == slow_find(terms, w), w


def test_exceptions():
    assert tx.Matcher([tx.Term("idiot", False)], frozenset(["idiom"])).find("idiom") is None


def test_disguises():
    matcher = tx.Matcher([tx.Term("idiot", False), tx.Term("scum", False), tx.Term("worthless", False)])
    found = lambda t: [(h[0], h[1], h[2]) for h in matcher.hits(t)]
    assert found("a jdiot scvm of id!ot and s_cum, 1d10t $cum w0rthle$s") == [
        (1, 1, 0), (2, 1, 1), (4, 0, 0), (6, 0, 1), (7, 0, 0), (8, 0, 1), (9, 0, 2),
    ]
    assert found("idiot_worthless idiot|then") == [(0, 0, 0), (1, 0, 0)]
    assert found("$ 10 ! the*time 5:30 a|b id!ots?") == [(5, 1, 0)]


def share_corpus(spark, n, seed):
    """One toxic document in ten; rare fragments by the thousand, none of which tells anything."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["x%x" % int(rng.paretovariate(0.5) % 4000) for _ in range(40)]
        if i % 10 == 0:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["idiot", "worthless", "pathetic", "scum"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 10 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_share_of_clean_documents_flagged_is_alike_at_all_sizes(spark):
    docs, labels = share_corpus(spark, 6000, 9)
    wrong = []
    for rows in (480, 4800):
        model = tx.fitted(docs, labels, rows)
        assert {t.text for t in model.terms} == {"idiot", "worthless", "pathetic", "scum"}
        got = tx.scored(docs, model).select("row.doc_id", "predicted").collect()
        wrong.append(sum(r["predicted"] for r in got if r["doc_id"] % 10))
        assert all(r["predicted"] for r in got if r["doc_id"] % 10 == 0)
    assert max(wrong) <= 1.5 * min(wrong) + 5


def brute_score(model, text):
    """The scorer word by word, with edit distances."""
    import re

    words = list(re.finditer(r"[@$]?[^\W_]+(?:[!@$*_|]+[^\W_]+)*", text.lower()))
    hits = []
    for n, m in enumerate(words):
        forms = {m[0]} if m[0].isalpha() else {m[0].translate(tx._ALIKE), *re.findall(r"[^\W_]+", m[0])}
        found = [f for w in forms if w not in model.exceptions and (f := slow_find(model.terms, w))]
        if found:
            edits, term = min(found)
            hits.append((n, model.weights[term, edits, tx.quoted(text.lower(), words, n)]))
    best = model.without
    for n, _ in hits:
        miss = 1.0
        for k, w in hits:
            if n <= k <= n + 2 * tx.REACH:
                miss *= 1 - w
        best = max(best, 1 - miss)
    return best


def test_query_against_brute_force(spark, tmp_path):
    docs, labels = share_corpus(spark, 600, 10)
    odd = [(9001, "you idjot, wortless id!ot", "a"), (9002, 'he said "scum" twice', "b"), (9003, None, None), (9004, "", "")]
    docs = docs.selectExpr("doc_id", "text", "'s' AS `a.b: c`").union(spark.createDataFrame(odd, "doc_id long, text string, s string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = tx.fitted(docs, labels)
    got = tx.op3_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 604
    for r in got:
        assert r["score"] == pytest.approx(brute_score(model, texts[r["doc_id"]] or "")), texts[r["doc_id"]]
        assert r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_context():
    matcher = tx.Matcher([tx.Term("idiot", False)])
    kinds = lambda t: [h[3] for h in matcher.hits(t)]
    assert kinds("you are an Idiot, go away") == [False]
    assert kinds('the sign read "an idiot lives here" in red') == [True]
    assert kinds("they said idiot") == [True] and kinds("« idiot » fut lu") == [True]
    model = tx.Model((tx.Term("idiot", False),), frozenset(), {(0, 0, False): 0.9, (0, 0, True): 0.3, (0, 1, False): 0.4, (0, 1, True): 0.2}, 0.01)
    score = lambda t: model.score(matcher.hits(t))
    assert score("") == 0.01 and score("an idiot") == pytest.approx(0.9)
    assert score('"idiot" he read') == pytest.approx(0.3)
    assert score("idjot idjot") == pytest.approx(0.64)
    assert score("idjot " + "w " * 30 + "idjot") == pytest.approx(0.4)


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    plain = [f"w{rng.randrange(10**6):x}" for _ in range(800)]
    bad = ["idiot", "worthless", "pathetic"]
    rows, labels = [], []
    for i in range(1200):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            t = rng.choice([*bad, "zorg" + rng.choice("abcdefghij") + rng.choice("xyz")])
            w[rng.randrange(len(w))] = t if rng.random() < 0.8 or len(t) < 7 else t[:3] + "q" + t[4:]
        rows.append((i, " ".join(w), "en", "s", 0.5))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None, "en", "s", 0.1), (5001, "", None, None, None), (None, "idiot worthless", "en", "s", 0.0)]
    labels += [(None, 1, 1), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    model = tx.fitted(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {"idiot", "worthless", "pathetic"} <= {t.text for t in model.terms} and any(t.stem and t.text == "zorg" for t in model.terms)
    got = {r["row"]["doc_id"]: r for r in tx.scored(docs, model).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i]["predicted"] == (i % 4 == 0) for i in held) / len(held)
    assert right > 0.97
    assert got[5000]["predicted"] == got[5001]["predicted"] == 0 and got[None]["predicted"] == 1
    assert 0 <= got[5000]["score"] == got[5001]["score"] < 0.1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = tx.fitted(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["predicted"] for r in tx.scored(docs, model).collect()] == [0, 0]
    assert tx.scored(docs.limit(0), model).collect() == []


def test_large_sample_keeps_rare_terms_and_counts_copies_once(spark):
    rng = random.Random(4)
    plain = [f"w{rng.randrange(10**6):x}" for _ in range(800)]
    some = lambda n: [rng.choice(plain) for _ in range(n)]
    original, rows, labels = [f"copy{i}" for i in range(40)], [], []
    for i in range(3000):
        w, toxic = some(30), i % 2
        if toxic and i % 60 == 1:
            w[rng.randrange(1, 30)] = "scumbag"  # in a fiftieth of the toxic documents
        if toxic and i % 5 == 0:  # a group of near copies
            w = [x for x in original]
            w[rng.randrange(40)] = rng.choice(plain)
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = tx.fitted(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    terms = {t.text for t in model.terms}
    assert "scumbag" in terms and not any(t.startswith("copy") for t in terms)
    fresh = spark.createDataFrame([(1, " ".join(some(20) + ["scumbag"] + some(20))), (2, " ".join(some(30) + ["copy7"]))], "doc_id long, text string")
    assert {r["row"]["doc_id"]: r["predicted"] for r in tx.scored(fresh, model).collect()} == {1: 1, 2: 0}
