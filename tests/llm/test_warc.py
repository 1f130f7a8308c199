"""WARC round trip: every page comes back, byte for byte, and the index is in order."""

import base64
import hashlib
import random

from hypothesis import given, settings, strategies as st

from taskfold.llm import warc
from taskfold.llm.loser_tree import merge

SCHEMA = "page_id long, url string, html string, digest string, n_bytes int"


@settings(deadline=None, max_examples=100)
@given(st.lists(st.lists(st.integers(0, 50)), max_size=9))
def test_merge(runs):
    runs = [sorted(r) for r in runs]
    tagged = [[(x, n) for x in r] for n, r in enumerate(runs)]
    assert list(merge(tagged, lambda t: t[0])) == sorted((t for r in tagged for t in r), key=lambda t: t[0])


def pages():
    rng = random.Random(1)
    html = [None, "", "<p>é</p>", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n", "\r\n\r\n", "x" * 3_000_000, "a\nb\r\n", "WARC/1.1\r\n"]
    html += [f"<p>{rng.random()}</p>" * rng.randrange(50) for _ in range(60)]
    urls = [None, "", "http://WWW.Example.com", "https://u@b.example.org:8443/x?y=1#z", "line\r\nWARC-Type: x", "http://hot.net/p"]
    return [(i, rng.choice(urls), rng.choice(html)) for i in rng.sample(range(1000), 300)] + [(None, "http://a/", "zz"), (5000, "http://a/", "zz"), (None, None, "only null")]


def brute(rows, least=0):
    holder = {}
    for i, _, h in rows:
        if i is not None:
            holder[h or ""] = max(i, holder.get(h or "", i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        top = holder.get(h or "")
        again = len(p) >= least and top is not None and i != top
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    for least in (0, 40):
        path = f"{tmp_path}/{least}"
        warc.write_archives(df, path, least, file_bytes=100_000)
        captures = warc.read_captures(spark, path)
        index = warc.capture_index(captures).orderBy("position").collect()
        assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in index), key=repr) == brute(rows, least)
        assert [r["position"] for r in index] == list(range(len(rows)))
        order = [(r["key"], r["date"], r["page_id"] is not None, r["page_id"] or 0) for r in index]
        assert order == sorted(order) and len({r["run"] for r in index}) > 3


def test_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 30)
    df = spark.createDataFrame([(i, "http://hot.net/p" if i % 3 else f"http://h{i}.net/", str(i)) for i in range(400)], "page_id long, url string, html string")
    warc.write_archives(df, f"{tmp_path}/w", file_bytes=20_000)
    index = warc.capture_index(warc.read_captures(spark, f"{tmp_path}/w")).orderBy("position").collect()
    order = [(r["key"], r["date"], r["page_id"]) for r in index]
    assert order == sorted(order) and len(order) == 400


def test_repeated_rows_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (0, "u", "same")], "page_id long, url string, html string")
    warc.write_archives(df, f"{tmp_path}/a")
    got = warc.read_captures(spark, f"{tmp_path}/a").collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]
    warc.write_archives(df.limit(0), f"{tmp_path}/b")
    assert warc.capture_index(warc.read_captures(spark, f"{tmp_path}/b")).collect() == []


def test_keys(spark):
    df = spark.createDataFrame([("http://WWW.Example.com",), ("https://u@b.example.org:8443/x?y=1#z",), (None,)], "u string")
    got = [r[0] for r in df.select(warc.url_key(df.u)).collect()]
    assert got == ["com,example)/", "org,example,b)/x?y=1", ")/"]
