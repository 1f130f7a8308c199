"""A row-at-a-time model of documents applied to projects, to compare the jobs with."""

import math
import random

REQUIRED = ("name", "domain", "description")
FIELDS = ("name", "domain", "description", "status", "tags", "context", "files_involved")
STATUSES = ("Pending", "InProgress", "Blocked", "Complete")


class Invalid(Exception):
    pass


def apply_document(items, doc):
    """New item list after one document; ``items`` is left alone."""
    items = [dict(f) for f in items]
    for pos, patch in enumerate(doc["features"]):
        old = next((f for f in items if f["id"] == patch["id"]), None)
        if old is None:
            for name in REQUIRED:
                if patch.get(name) is None:
                    raise Invalid(f"New feature '{patch['id']}' requires '{name}' field")
            old = {
                "id": patch["id"], "status": "Pending", "tags": [], "files_involved": [], "context": None,
                "created_at": doc["batch_ts"], "ord_batch": doc["batch_seq"], "ord_pos": pos,
            }
            items.append(old)
        old.update({n: patch[n] for n in FIELDS if patch.get(n) is not None})
        old["last_updated"] = doc["batch_ts"]
    gone = set(doc["remove_features"])
    return [f for f in items if f["id"] not in gone]


def replay(docs, base=None, lenient=False):
    """(state by project, {(project, batch): valid}). Strict replay stops a project at its first error."""
    state = {p: [dict(f) for f in fs] for p, fs in (base or {}).items()}
    verdicts = {}
    for doc in sorted(docs, key=lambda d: (d["project_id"], d["batch_seq"])):
        project = doc["project_id"]
        try:
            state[project] = apply_document(state.get(project, []), doc)
            verdicts[project, doc["batch_seq"]] = True
        except Invalid:
            verdicts[project, doc["batch_seq"]] = False
            if not lenient:
                raise
    return state, verdicts


def score(as_of, last_updated):
    return min(1.0, max(0.01, math.exp(-(0.693147 / 604800.0) * (as_of - last_updated))))


def random_documents(seed, n_docs=40, n_projects=3, n_ids=6, p_bare=0.35, first=1):
    """Documents in which some patches lack required fields and items come, go and come again."""
    rnd = random.Random(seed)
    docs = []
    for project in range(n_projects):
        for batch in range(first, first + n_docs):
            patches = []
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
                patch = {"id": f"i{rnd.randrange(n_ids)}"}
                if rnd.random() > p_bare:
                    patch.update(name=f"n{rnd.randrange(99)}", domain="d", description=f"x{rnd.randrange(99)}")
                elif rnd.random() < 0.5:
                    patch["name"] = f"m{rnd.randrange(99)}"
                if rnd.random() < 0.4:
                    patch["status"] = rnd.choice(STATUSES)
                if rnd.random() < 0.3:
                    patch["tags"] = rnd.choice([[], ["a"], ["b", "b"]])
                if rnd.random() < 0.3:
                    patch["context"] = f"c{rnd.randrange(99)}"
                if rnd.random() < 0.2:
                    patch["files_involved"] = rnd.choice([[], ["p/q"]])
                patches.append(patch)
            removed = [f"i{rnd.randrange(n_ids + 1)}" for _ in range(rnd.choice([0, 0, 0, 1, 2]))]
            docs.append({
                "project_id": f"p{project}", "batch_seq": batch, "batch_ts": 1000 + 7 * batch,
                "features": patches, "remove_features": removed,
            })
    return docs


def valid_documents(seed, **options):
    """The documents a lenient replay accepts: a valid log."""
    docs = random_documents(seed, **options)
    _, verdicts = replay(docs, lenient=True)
    return [d for d in docs if verdicts[d["project_id"], d["batch_seq"]]]


def spark_documents(spark, docs):
    from taskfold.schema import UPDATE_DOC

    whole = [
        {**d, "features": [{n: p.get(n) for n in ("id", *FIELDS)} for p in d["features"]]} for d in docs
    ]
    return spark.createDataFrame(whole, UPDATE_DOC)


def rows_of(state):
    """State as comparable tuples."""
    return sorted(
        (p, f["id"], f["name"], f["domain"], f["description"], f["status"], tuple(f["tags"]), f["context"] or "",
         tuple(f["files_involved"]), f["created_at"], f["last_updated"], f["ord_batch"], f["ord_pos"])
        for p, fs in state.items() for f in fs
    )


def spark_rows(df):
    return sorted(
        (r.project_id, r.id, r.name, r.domain, r.description, r.status, tuple(r.tags), r.context or "",
         tuple(r.files_involved), r.created_at, r.last_updated, r.ord_batch, r.ord_pos)
        for r in df.collect()
    )
