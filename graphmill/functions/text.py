"""Column functions on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that only say that a value is missing, in lower case.
MISSING = ("", "none", "null", "nan", "n/a", "na", "unknown", "?", "-", "(none)", "--", "nil", "missing", "undefined", "<na>", "#n/a", "not available")


def stripped(c: Column) -> Column:
    """c without outer white space of any kind."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def folded(c: Column) -> Column:
    """c without outer white space, in lower case: the form in which names are compared."""
    return F.lower(stripped(c))


def is_real(c: Column) -> Column:
    """Whether c holds a value: it isn't null, blank or a text that only says that the value is missing."""
    return F.coalesce(~folded(c).isin(*MISSING), F.lit(False))


def number(c: Column) -> Column:
    """c with NaN as null."""
    return F.when(~F.isnan(c), c)
