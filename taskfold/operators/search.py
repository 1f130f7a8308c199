"""Search: one query as a filter, many queries as equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from taskfold import fixed
from taskfold.schema import KEY, STORED_ORDER

TEXT_FIELDS = ("id", "name", "domain", "description", "context")


def keyword_text(keyword: str | list[str]) -> str:
    """Several words form one phrase, joined by single spaces."""
    return keyword if isinstance(keyword, str) else " ".join(keyword)


def keyword_predicate(keyword: str | Column) -> Column:
    """Literal, case-insensitive substring of any text field or tag; a null field never matches."""
    word = F.lower(keyword if isinstance(keyword, Column) else F.lit(keyword))
    fields = [F.coalesce(F.lower(F.col(c)).contains(word), F.lit(False)) for c in TEXT_FIELDS]
    in_tags = F.exists("tags", lambda t: F.lower(t).contains(word))
    return reduce(lambda a, b: a | b, [*fields, F.coalesce(in_tags, F.lit(False))])


def domain_predicate(domain: str | Column, lowered: str | None = None) -> Column:
    """Case-insensitive equality. ``lowered`` names a stored lower-case column, which reaches the scan."""
    wanted = F.lower(domain if isinstance(domain, Column) else F.lit(domain))
    return (F.col(lowered) if lowered else F.lower("domain")) == wanted


def tag_predicate(tag: str | Column) -> Column:
    """Some whole tag equals the given one, whatever the case."""
    wanted = F.lower(tag if isinstance(tag, Column) else F.lit(tag))
    return F.exists("tags", lambda t: F.lower(t) == wanted)


def status_predicate(status: str | Column) -> Column:
    """Case-insensitive; an unknown status matches nothing.

    A literal is resolved to the stored spelling, so the filter is pushed down as plain equality.
    """
    if isinstance(status, Column):
        return F.lower("status") == F.lower(status)
    stored = [s for s in fixed.STATUSES if s.lower() == status.lower()]
    return F.col("status") == stored[0] if stored else F.lit(False)


def search(
    features: DataFrame,
    keyword: str | list[str] | None = None,
    domain: str | None = None,
    tag: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Items that satisfy every given filter. Order is left to :func:`in_stored_order`."""
    conditions = []
    if status is not None:
        conditions.append(status_predicate(status))
    if domain is not None:
        conditions.append(domain_predicate(domain, "domain_lc" if "domain_lc" in features.columns else None))
    if tag is not None:
        conditions.append(tag_predicate(tag))
    if keyword is not None:
        conditions.append(keyword_predicate(keyword_text(keyword)))
    if not conditions:
        raise ValueError("give at least one of keyword, domain, tag, status")
    return features.filter(reduce(lambda a, b: a & b, conditions))


def in_stored_order(features: DataFrame) -> DataFrame:
    """Creation order within each project (a range-partitioned sort)."""
    return features.orderBy("project_id", *STORED_ORDER)


def lookup(features: DataFrame, project_id: str, item_id: str) -> DataFrame:
    """Point lookup; both conditions are pushed to the scan."""
    return features.filter((F.col("project_id") == project_id) & (F.col("id") == item_id))


def lookup_many(features: DataFrame, keys: DataFrame) -> DataFrame:
    """Items whose (project_id, id) is in ``keys``."""
    return features.join(keys.select(*KEY), list(KEY), "left_semi")


def count_matches(features: DataFrame, **filters) -> DataFrame:
    return search(features, **filters).agg(F.count("*").alias("n_matches"))
