"""Times the headline operators; prints one JSON line.

BENCH_SF_DIR names the test tables, BENCH_CPUS the number of local cores. The tables of the data model
are derived and stored first (not timed), as a user would have them; each operator then runs over its
whole input into a sink that discards the rows. Reported: median seconds of the warm runs.
"""

import json
import os
import statistics
import sys
import time

from taskfold.operators import changelog, housekeeping, inventory, lenient, many_search, report, search
from taskfold.plans import standins as st
from taskfold.schema import FEATURE
from taskfold.session import builder, stored
from taskfold.sources import documents

RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        builder("bench")
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    cores = int(cpus)
    keep = lambda df, name: stored(df.repartition(cores), name)
    items = keep(st.features(spark, folder).withColumn("domain_lc", st.F.lower("domain")), "items")
    projects = keep(st.projects(spark, folder), "projects")
    raw, clean = keep(st.raw_log(spark, folder), "raw"), keep(st.clean_log(spark, folder), "clean")
    listing = keep(st.file_listing(spark, folder), "listing")
    asked = keep(st.search_queries(spark, folder), "asked")
    docs = keep(st.event_documents(spark, folder).selectExpr("to_json(struct(*)) AS json"), "docs")
    nothing = spark.createDataFrame([], FEATURE)
    middle = st.F.col("batch_seq") < st.MIDDLE_DAY
    base = keep(changelog.replay(nothing, clean.filter(middle), st.AS_OF), "base")
    sizes = {n: df.count() for n, df in [("items", items), ("log", clean), ("paths", listing), ("queries", asked)]}

    work = {
        "top_keyword_in_domain": lambda: report.top_by_recency(search.search(items, keyword="eau", domain="fr")),
        "search_keyword": lambda: search.search(items, keyword="eau"),
        "search_domain_status": lambda: search.search(items, domain="FR", status="pending"),
        "search_many": lambda: many_search.search_many(items, asked),
        "top_by_recency": lambda: report.top_by_recency(items),
        "ranked_report": lambda: report.report_rows(report.ranked(items)),
        "completion_summary": lambda: report.completion_summary(items, projects),
        "state_documents": lambda: documents.state_documents(items, projects),
        "parse_documents": lambda: documents.flatten_documents(documents.parse_documents(docs)),
        "replay_log": lambda: changelog.replay(nothing, clean, st.AS_OF),
        "merge_into_registry": lambda: changelog.replay(base, clean.filter(~middle), st.AS_OF),
        "first_bad_documents": lambda: changelog.first_bad_documents(raw),
        "lenient_replay": lambda: lenient.replay_lenient(nothing, raw, st.AS_OF),
        "extension_histogram": lambda: inventory.extension_histogram(listing),
        "suggested_features": lambda: inventory.suggested_features(listing),
        "discovery_reports": lambda: inventory.report_documents(listing),
        "facets": lambda: housekeeping.facets(items),
        "file_index": lambda: housekeeping.file_index(items),
        "limit_audit": lambda: housekeeping.limit_audit(items),
    }
    only = sys.argv[1:]
    times = {}
    for name, make in work.items():
        if only and name not in only:
            continue
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 4)
        print(name, times[name], file=sys.stderr, flush=True)
    rate = lambda rows, name: round(rows / times[name]) if name in times else None
    print(
        json.dumps(
            {
                "metric": "total of the median warm seconds of all headline operators",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cores,
                "rates": {
                    "change_rows_replayed_per_sec": rate(sizes["log"], "replay_log"),
                    "paths_profiled_per_sec": rate(sizes["paths"], "discovery_reports"),
                    "query_item_pairs_per_sec": rate(sizes["queries"] * sizes["items"], "search_many"),
                },
                "rows": sizes,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
