import pytest
from pyspark.sql import functions as F

from model import score
from taskfold import fixed
from taskfold.functions import paths, recency, text


def values(spark, inputs, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_extension(spark):
    cases = {
        "README": None, ".gitignore": None, "a/.foo.bar": "bar", "foo.": "", "x.tar.gz": "gz", "a/b.RS": "rs",
        "a.b/c": None, "a.b/.c": None, "dir/x.y.": "", "..a": "a", "é.Ü": "ü", "http://h.example.com/en/1": None,
    }
    assert dict(zip(cases, values(spark, cases, paths.extension))) == cases


def test_skipped_directories(spark):
    cases = {
        "build": False, "a/build": False, "a/build/x.rs": True, "build/x": True, "src/bin/a/b": True, ".github/x": False,
        "buildx/y": False, "xbuild/y": False, "node_modules/a/b/c": True, "a.git/b": False, "agit/b": False,
    }
    assert dict(zip(cases, values(spark, cases, paths.under_skipped_directory))) == cases
    every = [f"deep/{name}/file" for name in fixed.SKIP_DIRS]
    assert values(spark, every, paths.under_skipped_directory) == [True] * 8


def test_directory_tests(spark):
    cases = {"src/a/x": True, "src/x": False, "src/.a/x": False, "docs/a/x": False, "lib/a/b/c": True, "src2/a/x": False}
    assert dict(zip(cases, values(spark, cases, paths.below_source_root))) == cases
    cases = {"src/a": True, "a": False, ".hid/a": False, "target/a": False, "targets/a": True, "bin/x/y": False}
    assert dict(zip(cases, values(spark, cases, paths.in_visible_top_directory))) == cases


def test_relative(spark):
    assert values(spark, ["/r/a/b", "/r2/a", "/r"], lambda p: paths.relative_to(p, F.lit("/r/"))) == ["a/b", None, None]


def test_title_case(spark):
    cases = {"user_auth-JWT": "User Auth JWT", "__x": "X", "": "", "a--b": "A B", "éclair_x": "Éclair X", "DB": "DB"}
    assert dict(zip(cases, values(spark, cases, text.title_case))) == cases


def test_infer_domain(spark):
    cases = {
        "user_auth": "security", "Sessions": "security", "rapid": "api", "my_db": "storage", "guide": "ui",
        "latest": "testing", "Core": "core", "auth_api": "security", "schema_test": "storage",
    }
    assert dict(zip(cases, values(spark, cases, text.infer_domain))) == cases


def test_truncate(spark):
    assert values(spark, ["abcde", "abcdef", "", "ééééééé"], lambda c: text.truncate(c, 5)) == ["abcde", "abc..", "", "ééé.."]


@pytest.mark.parametrize(
    "age, expected", [(0, 1.0), (604800, 0.5), (30 * 86400, 0.0513), (47 * 86400, 0.01), (-60, 1.0), (10**9, 0.01)]
)
def test_recency(spark, age, expected):
    as_of = 1_700_000_000
    df = spark.createDataFrame([(as_of - age,)], "t long")
    got = df.select(recency.recency_score(F.col("t"), as_of)).first()[0]
    assert got == pytest.approx(score(as_of, as_of - age), abs=1e-12)
    assert got == pytest.approx(expected, abs=1e-4)


def test_half_life_uses_six_digits(spark):
    got = spark.range(1).select(recency.recency_score(F.lit(0).cast("long"), 604800)).first()[0]
    assert got != 0.5 and got > 0.5


def test_percent(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 0.01), (2, 0.125), (3, 0.135), (4, 0.996)], "i int, s double").orderBy("i")
    assert [r[0] for r in df.select(recency.percent_label(F.col("s"))).collect()] == ["100%", "1%", "12%", "14%", "100%"]
