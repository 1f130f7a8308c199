"""Views kept by changes equal a recount after every batch."""

import model
from taskfold.operators import housekeeping, report, views
from taskfold.operators.changelog import replay
from taskfold.schema import FEATURE
from taskfold.session import stored
from taskfold.sources.documents import flatten_documents


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_views_after_every_batch(spark, tmp_path):
    docs = model.valid_documents(31, n_docs=16, n_projects=2, n_ids=7)
    for d in docs:
        for k, p in enumerate(d["features"]):
            p.setdefault("files_involved", [f"src/{(d['batch_seq'] + k) % 4}.py", "lib/x.rs"])
    now = spark.createDataFrame([], FEATURE)
    roots = {v: f"{tmp_path}/{v}" for v in views.COUNTS}
    for v, root in roots.items():
        views.create(v, now, root, 0)
    for number, batch in enumerate(sorted({d["batch_seq"] for d in docs}), 1):
        log = flatten_documents(model.spark_documents(spark, [d for d in docs if d["batch_seq"] == batch]))
        keys = log.select("project_id", "id").distinct()
        then = stored(replay(now, log, 9), "then")
        touched = [x.join(keys, ["project_id", "id"], "left_semi") for x in (now, then)]
        for v, root in roots.items():
            views.apply(v, *touched, root, number)
        if number == 5:
            assert views.fold(spark, roots[views.FACETS]) == 5 == views.fold(spark, roots[views.FACETS])
        now = then
        facets = views.read(spark, roots[views.FACETS])
        assert rows(facets.withColumnRenamed("n", "n_features")) == rows(housekeeping.facets(now))
    assert number >= 10
    assert rows(views.feature_counts(facets)) == rows(report.feature_counts(now))
    assert rows(views.completion_summary(facets)) == rows(report.completion_summary(now))
    postings = views.read(spark, roots[views.POSTINGS])
    assert rows(postings.select("project_id", "file", "id")) == rows(housekeeping.file_postings(now)) and postings.count() > 5
    assert rows(views.file_index(postings, 2)) == rows(housekeeping.file_index(now, 2))
    before = rows(postings)
    views.fold(spark, roots[views.POSTINGS])
    assert rows(views.read(spark, roots[views.POSTINGS])) == before
    assert views.read(spark, roots[views.POSTINGS], 0).count() == 0
