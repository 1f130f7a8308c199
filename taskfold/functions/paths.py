"""Path expressions over relative, '/'-separated paths.

Each is written so that the path occurs in it once: Spark moves filters down to the scan, and there the
path may itself be a long expression.
"""

import re

from pyspark.sql import Column, functions as F

from taskfold import fixed


def _any_of(names) -> str:
    return "|".join(re.escape(n) for n in names)


_SKIPPED = f"(?:^|/)(?:{_any_of(fixed.SKIP_DIRS)})/"
_SUB_OF_ROOT = f"^(?:{_any_of(fixed.SOURCE_ROOTS)})/[^./][^/]*/"
_VISIBLE_TOP = f"^(?!(?:{_any_of(fixed.SKIP_DIRS)})/)[^./][^/]*/"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def top_component(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def second_component(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", 2), "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name.

    Null when there is no dot, or the only dot opens the name (``.gitignore``); empty for ``name.``.
    """
    return F.lower(F.substring(F.regexp_substr(path, F.lit(r"(?<=[^/])\.[^./]*$")), 2, 2**31 - 1))


def is_hidden(name: Column) -> Column:
    return name.startswith(".")


def under_skipped_directory(path: Column) -> Column:
    """True when any directory above the file (never the file itself) has a skipped name."""
    return path.rlike(_SKIPPED)


def in_visible_top_directory(path: Column) -> Column:
    """True for a file in some first-level directory that is neither hidden nor skipped."""
    return path.rlike(_VISIBLE_TOP)


def below_source_root(path: Column) -> Column:
    """True for a file below a visible sub-directory of a source root."""
    return path.rlike(_SUB_OF_ROOT)


def relative_to(path: Column, root: Column) -> Column:
    """Path without a leading ``root/``; null when the path is not below the root."""
    base = F.regexp_replace(root, "/+$", "")
    return F.when(path.startswith(F.concat(base, F.lit("/"))), path.substr(F.length(base) + 2, F.length(path)))
