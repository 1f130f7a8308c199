"""Folding change logs into the registry.

Rows of a log are ordered by (batch_seq, op_rank, pos): inside a document all upserts come before all
removals. A removal ends an item's *generation*; a later upsert opens a new one, which inherits
nothing. An upsert that opens a generation must bring name, domain and description.

A fold needs one ordered look back per key (is the item alive before this row?) and one aggregate.
Both use the partitioning by (project_id, id), so an ordinary log is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taskfold import fixed
from taskfold.functions.recency import recency_score
from taskfold.operators.skew import HEAVY_ROWS, HeavyKeys, find_heavy_keys, prior_max
from taskfold.schema import FEATURE, KEY, PATCH_NAMES, REMOVE, UPSERT


def log_order() -> list[Column]:
    return [F.col("batch_seq"), F.col("op_rank"), F.col("pos")]


def heavy_log_keys(log: DataFrame, min_rows: int | None) -> HeavyKeys | None:
    """Items with so many changes that one task should not take them all. None: there are known to be none."""
    return None if min_rows is None else find_heavy_keys(log, KEY, log_order(), min_rows)


def missing_field() -> Column:
    """The first required field this change does not bring, or null."""
    out = F
    for name in fixed.REQUIRED_ON_CREATE:
        out = out.when(F.col(name).isNull(), name)
    return out


def is_unreadable() -> Column:
    """A change no document may hold: a status not spelled as stored, or no id."""
    odd_status = F.col("status").isNotNull() & ~F.col("status").isin(*fixed.STATUSES)
    return F.col("id").isNull() | odd_status


def bad_status_documents(log: DataFrame) -> DataFrame:
    """Documents with a status outside the domain or a change without an id: rejected as a whole."""
    return log.filter(is_unreadable()).select("project_id", "batch_seq").distinct()


def with_liveness(log: DataFrame, min_heavy_rows: int | None = HEAVY_ROWS) -> DataFrame:
    """Add ``is_first`` (no earlier change of the item in the log) and ``opens`` (upsert of an item not alive).

    ``opens`` takes the log alone: an item of an earlier snapshot is not known here.
    """
    upsert, remove = F.col("op_rank") == UPSERT, F.col("op_rank") == REMOVE
    seen = prior_max(
        log,
        KEY,
        log_order(),
        {"_up": F.when(upsert, F.col("batch_seq")), "_down": F.when(remove, F.col("batch_seq"))},
        heavy_log_keys(log, min_heavy_rows),
    )
    up, down = F.col("_up"), F.col("_down")
    alive = up.isNotNull() & (down.isNull() | (up > down))
    return seen.withColumns({"is_first": up.isNull() & down.isNull(), "opens": upsert & ~alive}).drop("_up", "_down")


def fold_log(log: DataFrame, min_heavy_rows: int | None = HEAVY_ROWS) -> DataFrame:
    """Net effect of a log, one row per item.

    ``removed_at``: batch of the last removal; ``alive``: the item exists at the end of the log;
    the patch columns hold the last provided value of the live generation; ``opened`` and ``touched``
    are the first and last upsert of it. ``bad`` is the first re-creation without a required field;
    ``head`` tells the same of the very first change, which is bad only for an item unknown before; ``odd``
    is the first change no document may hold.
    """
    rows = with_liveness(log, min_heavy_rows).withColumn("_missing", missing_field())
    upsert = f"op_rank = {UPSERT}"
    stamp = "struct(batch_seq, pos, batch_ts)"
    flaw = "named_struct('batch_seq', batch_seq, 'pos', pos, 'field', _missing)"
    # max_by ignores rows with a null ordering value, so it takes the last *provided* value.
    last_value = (
        "max_by(named_struct('v', {0}, 'b', batch_seq), CASE WHEN " + upsert + " AND {0} IS NOT NULL THEN struct(batch_seq, pos) END) AS {0}"
    )
    folded = rows.groupBy(*KEY).agg(
        F.expr(f"max(CASE WHEN NOT {upsert} THEN batch_seq END) AS removed_at"),
        F.expr(f"max(CASE WHEN opens THEN {stamp} END) AS opened"),
        F.expr(f"max(CASE WHEN {upsert} THEN {stamp} END) AS touched"),
        F.expr(f"min(CASE WHEN opens AND NOT is_first AND _missing IS NOT NULL THEN {flaw} END) AS bad"),
        F.expr(f"min(CASE WHEN opens AND is_first AND _missing IS NOT NULL THEN {flaw} END) AS head"),
        F.min(F.when(is_unreadable(), F.expr(flaw.replace("_missing", "CAST(NULL AS STRING)")))).alias("odd"),
        *[F.expr(last_value.format(n)) for n in PATCH_NAMES],
    )
    after_removal = "(removed_at IS NULL OR {} > removed_at)"
    return folded.selectExpr(
        *KEY,
        "removed_at",
        f"coalesce({after_removal.format('touched.batch_seq')}, false) AS alive",
        "opened",
        "touched",
        "bad",
        "head",
        "odd",
        *[f"CASE WHEN {after_removal.format(f'{n}.b')} THEN {n}.v END AS {n}" for n in PATCH_NAMES],
    )


def _joined(base: DataFrame, folded: DataFrame) -> DataFrame:
    """Registry and net changes side by side, with the first flaw of each item as ``flaw``."""
    return (
        base.alias("b")
        .join(folded.alias("d"), F.expr("b.project_id = d.project_id AND b.id = d.id"), "full_outer")
        .selectExpr(
            "coalesce(b.project_id, d.project_id) AS project_id",
            "coalesce(b.id, d.id) AS id",
            "struct(b.*) AS old",
            "struct(d.*) AS new",
            "b.id IS NOT NULL AS known",
            "d.id IS NOT NULL AS changed",
            "least(d.odd, d.bad, CASE WHEN b.id IS NULL THEN d.head END) AS flaw",
        )
    )


def replay(
    base: DataFrame,
    log: DataFrame,
    as_of: int | DataFrame,
    check: bool = True,
    min_heavy_rows: int | None = HEAVY_ROWS,
) -> DataFrame:
    """The registry after all documents of ``log`` are applied to ``base``.

    ``as_of`` is the clock of the recomputed scores: epoch seconds for all projects, or a table
    (project_id, as_of), in which case projects it does not name keep their stored scores.
    With ``check``, an invalid creation or an unknown status fails the whole job, so nothing half-applied
    can be stored; :func:`first_bad_documents` and :func:`bad_status_documents` tell which document it was.
    """
    both = _joined(base, fold_log(log, min_heavy_rows))
    stays = F.when(F.col("changed"), F.col("new.alive")).otherwise(F.col("known"))
    if check:
        flaw = F.col("flaw")
        place = [F.col("project_id"), flaw["batch_seq"].cast("string")]
        message = F.when(
            flaw["field"].isNull(), F.format_string("unknown status or missing id (project %s, document %s)", *place)
        ).otherwise(
            F.format_string(f"{fixed.MISSING_FIELD_TEXT} (project %s, document %s)", F.col("id"), flaw["field"], *place)
        )
        stays = F.when(flaw.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(stays)
    both = both.filter(stays)

    keeps_old = "known AND new.removed_at IS NULL"  # true for every unchanged item
    nothing = "CAST(array() AS ARRAY<STRING>)"
    default = {"status": f"'{fixed.DEFAULT_STATUS}'", "tags": nothing, "files_involved": nothing}

    def kept_or(name: str, otherwise: str) -> str:
        return f"CASE WHEN {keeps_old} THEN old.{name} ELSE {otherwise} END AS {name}"

    merged = both.selectExpr(
        *KEY,
        *[
            f"coalesce(new.{n}, CASE WHEN {keeps_old} THEN old.{n} END, {default.get(n, 'NULL')}) AS {n}"
            for n in PATCH_NAMES
        ],
        kept_or("created_at", "new.opened.batch_ts"),
        "CASE WHEN changed THEN new.touched.batch_ts ELSE old.last_updated END AS last_updated",
        kept_or("recency_score", f"CAST({fixed.INITIAL_SCORE} AS DOUBLE)"),
        kept_or("ord_batch", "new.opened.batch_seq"),
        kept_or("ord_pos", "new.opened.pos"),
    )
    return _scored(merged, as_of).select(*FEATURE.fieldNames())


def _scored(features: DataFrame, as_of: int | DataFrame) -> DataFrame:
    if isinstance(as_of, DataFrame):
        clocked = features.join(as_of.select("project_id", F.col("as_of").alias("_as_of")), "project_id", "left")
        fresh = recency_score(F.col("last_updated"), F.col("_as_of"))
        return clocked.withColumn(
            "recency_score", F.when(F.col("_as_of").isNull(), F.col("recency_score")).otherwise(fresh)
        ).drop("_as_of")
    return features.withColumn("recency_score", recency_score(F.col("last_updated"), as_of))


def first_bad_documents(
    log: DataFrame, base: DataFrame | None = None, min_heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Per project, the first document that creates an item without a required field.

    Exact, because every document before it was valid. Later ones need :mod:`taskfold.operators.lenient`.
    """
    folded = fold_log(log.select(*_slim(log)), min_heavy_rows)
    if base is None:
        flaws = folded.select(*KEY, F.least("bad", "head").alias("flaw"))
    else:
        flaws = (
            folded.filter("bad is not null or head is not null")
            .join(base.select(*KEY, F.lit(True).alias("_known")), list(KEY), "left")
            .select(*KEY, F.least(F.col("bad"), F.when(F.col("_known").isNull(), F.col("head"))).alias("flaw"))
        )
    first = F.min(
        F.struct(
            F.col("flaw.batch_seq").alias("batch_seq"),
            F.col("flaw.pos").alias("pos"),
            F.col("id").alias("id"),
            F.col("flaw.field").alias("field"),
        )
    )
    return (
        flaws.filter(F.col("flaw").isNotNull())
        .groupBy("project_id")
        .agg(first.alias("first"))
        .select("project_id", "first.*")
    )


def invalid_creations(log: DataFrame, min_heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Every change that would open a generation without a required field, reading the log alone."""
    return (
        with_liveness(log.select(*_slim(log)), min_heavy_rows)
        .withColumn("field", missing_field())
        .filter(F.col("opens") & F.col("field").isNotNull())
        .select("project_id", "batch_seq", "pos", "id", "field")
    )


def fold_document(log: DataFrame) -> DataFrame:
    """Net patch per item when each item's changes come from one document: the last provided value wins.

    Needs no look back, so all of it is combined before the shuffle.
    """
    upsert = F.col("op_rank") == UPSERT
    value = lambda n: F.max_by(F.col(n), F.when(upsert & F.col(n).isNotNull(), F.struct("batch_seq", "pos"))).alias(n)
    return log.groupBy(*KEY, "batch_seq").agg(
        F.count_if(upsert).alias("n_patches"),
        (F.max("op_rank") == REMOVE).alias("removed"),
        *[value(n) for n in PATCH_NAMES],
    )


def remove_features(features: DataFrame, removals: DataFrame) -> DataFrame:
    """Drop the named items; unknown names are ignored."""
    return features.join(removals.select(*KEY).distinct(), list(KEY), "left_anti")


def append_features(features: DataFrame, more: DataFrame) -> DataFrame:
    """Add rows as they are, with no look for duplicates."""
    return features.unionByName(more)


def set_status(features: DataFrame, condition: Column, status: str, now: int) -> DataFrame:
    """Give the chosen items a status and the current time."""
    if status not in fixed.STATUSES:
        raise ValueError(f"unknown status {status!r}")
    chosen = F.coalesce(condition, F.lit(False))
    time = F.when(chosen, F.lit(now).cast("long")).otherwise(F.col("last_updated"))
    # Both at once, so that the condition sees the old values.
    return features.withColumns(
        {"status": F.when(chosen, F.lit(status)).otherwise(F.col("status")), "last_updated": time}
    )


def touch(features: DataFrame, condition: Column, now: int) -> DataFrame:
    """Give the chosen items the current time."""
    chosen = F.coalesce(condition, F.lit(False))
    return features.withColumn(
        "last_updated", F.when(chosen, F.lit(now).cast("long")).otherwise(F.col("last_updated"))
    )


def mark_complete(features: DataFrame, condition: Column, now: int) -> DataFrame:
    return set_status(features, condition, fixed.DONE_STATUS, now)


def project_clock(documents: DataFrame) -> DataFrame:
    """Time of the last document of each project, empty documents included."""
    latest = F.max_by("batch_ts", "batch_seq")
    return documents.groupBy("project_id").agg(latest.alias("as_of"))


def touch_projects(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """Move each project's ``last_updated`` to its last document."""
    return (
        projects.join(project_clock(documents), "project_id", "left")
        .withColumn("last_updated", F.coalesce("as_of", "last_updated"))
        .select(*projects.columns)
    )


def duplicate_keys(features: DataFrame) -> DataFrame:
    """Items stored more than once. A registry must have none."""
    return features.groupBy(*KEY).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def _slim(log: DataFrame) -> list[Column]:
    """The log without texts: checks need to know only which fields a change brings."""
    given = {n: F.when(F.col(n).isNotNull(), F.lit("")).alias(n) for n in fixed.REQUIRED_ON_CREATE}
    empty = {n: F.lit(None).cast(log.schema[n].dataType).alias(n) for n in PATCH_NAMES if n not in given}
    return [given.get(c, empty.get(c, F.col(c))) for c in log.columns]
