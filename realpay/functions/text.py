"""String helpers: join-key normalisation and list splitting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def normalize_key(x, unicode_spaces: bool = True) -> Column:
    """Trim a join key.

    Every Unicode space separator (space, NBSP, U+3000, ...) is stripped from
    both ends, as DuckDB's TRIM does; ``unicode_spaces=False`` strips the
    ASCII space only, as Spark's.
    """
    c = _as_col(x)
    if unicode_spaces:
        return F.regexp_replace(c, r"^[\p{Zs}]+|[\p{Zs}]+$", "")
    return F.trim(c)


def split_tokens(x, sep: str = ",") -> Column:
    """Split a delimited string into an array (``string_split``).

    ``F.split`` takes a regular expression, so the literal separator is
    escaped. A NULL string gives a NULL array (no rows after ``explode``).
    """
    return F.split(_as_col(x), re.escape(sep))
