"""Text helpers, all built from JVM expressions."""

from pyspark.sql import Column, functions as F

from taskfold import fixed


def title_case(name: Column) -> Column:
    """``user_auth-JWT`` -> ``User Auth JWT``: only first letters change."""
    words = F.filter(F.split(name, "[_-]"), lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(w.substr(F.lit(1), F.lit(1))), w.substr(F.lit(2), F.length(w)))),
        " ",
    )


def truncate(text: Column, width: int) -> Column:
    """Text of at most ``width`` characters; longer text ends in a cut mark."""
    kept = width - len(fixed.CUT_MARK)
    return F.when(F.length(text) <= width, text).otherwise(
        F.concat(F.substring(text, 1, kept), F.lit(fixed.CUT_MARK))
    )


def infer_domain(name: Column) -> Column:
    """Domain of a directory name; the lower-cased name itself if no word is found in it."""
    low = F.lower(name)
    out = None
    for domain, words in fixed.DOMAIN_WORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        out = F.when(hit, domain) if out is None else out.when(hit, domain)
    return out.otherwise(low)
