"""Randomness as a pure function of names: the same in Spark, Python and SQL.

A seed is the first 15 hexadecimal digits of md5(root|stage|key|...), so adding a stage, layout or graph never
changes another's, and neither do partitions, order or earlier runs.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 15


def seed(root: int, *keys: object) -> int:
    """The seed of keys below root."""
    return int(hashlib.md5("|".join(str(k) for k in (root, *keys)).encode()).hexdigest()[:DIGITS], 16)


def seed_column(root: int, *keys: Column | str) -> Column:
    """seed() of columns; strings are literal."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(k) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(root)), *parts)), 1, DIGITS), 16, 10).cast("long")


def unit(digest: Column, at: int) -> Column:
    """A number in [0, 1) from six digits of a digest, beginning at position at (from 1)."""
    return F.conv(F.substring(digest, at, 6), 16, 10).cast("double") / float(16**6)
