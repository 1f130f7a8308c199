"""Recency score: exponential decay with a seven-day half-life, kept within [0.01, 1]."""

from pyspark.sql import Column, functions as F

from taskfold import fixed


def recency_score(last_updated: Column, as_of: Column | int) -> Column:
    """Score of an item last touched at ``last_updated`` (epoch seconds), seen at ``as_of``.

    Items touched after ``as_of`` get the ceiling.
    """
    age = (_col(as_of) - last_updated).cast("double")
    decayed = F.exp(F.lit(-(fixed.LN_2 / fixed.HALF_LIFE_SECONDS)) * age)
    return F.greatest(F.lit(fixed.SCORE_FLOOR), F.least(F.lit(fixed.SCORE_CEILING), decayed))


def percent_label(score: Column) -> Column:
    """``0.5`` -> ``50%``, halves to the even neighbour."""
    return F.concat(F.bround(score * 100.0, 0).cast("int").cast("string"), F.lit("%"))


def _col(value):
    return value if isinstance(value, Column) else F.lit(value).cast("long")
