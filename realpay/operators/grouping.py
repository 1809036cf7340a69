"""Grouped means/counts, top-k and token counting (the report's SQL blocks).

All aggregations are partial + final hash aggregates: each map task folds its
rows per key before the shuffle, so a hot key sends one row per task.
Top-k sorts become ``TakeOrderedAndProject`` (a per-task heap of k rows).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from realpay.functions.numbers import nan_to_null
from realpay.functions.rounding import round_half_away
from realpay.functions.text import normalize_key, split_tokens
from realpay.operators.selection import local_frame


def group_means(df: DataFrame, key: str, means: Mapping[str, str], count_name: str = "job_count",
                scale: int | None = 2, order_by: str | None = None, descending: bool = False,
                k: int | None = None, columns_order: Sequence[str] | None = None) -> DataFrame:
    """``SELECT key, ROUND(AVG(x), scale) AS alias.., COUNT(*) AS count_name
    GROUP BY key ORDER BY order_by [LIMIT k]`` with SQL semantics: the NULL
    key is a group, ROUND is half away from zero, NULLs sort last, ties are
    broken by the key (the sort uses the rounded value, as the SQL does). NaN
    counts as missing.
    """
    aggs = [F.avg(nan_to_null(F.col(src).cast("double"))).alias(alias) for alias, src in means.items()]
    out = df.groupBy(key).agg(*aggs, F.count(F.lit(1)).alias(count_name))
    if scale is not None:
        out = out.select(key, *[round_half_away(a, scale).alias(a) for a in means], count_name)
    if columns_order:
        out = out.select(*columns_order)
    if order_by:
        first = F.desc_nulls_last(order_by) if descending else F.asc_nulls_last(order_by)
        keys = [first] if order_by == key else [first, F.asc_nulls_last(key)]
        out = out.orderBy(*keys)
    if k is not None:
        out = out.limit(k)
    return out


def top_tokens(df: DataFrame, column: str, sep: str = ",", k: int | None = 10,
               token_name: str = "skill", count_name: str = "count", summary: int | None = None) -> DataFrame:
    """Split a delimited list, trim, drop empty tokens, count, top ``k``.

    ``explode`` is narrow; the count is pre-aggregated per task, so only
    distinct tokens cross the shuffle. Ties are broken by the token.

    ``summary`` is for vocabularies too large for that: a first pass (run now)
    keeps that many counters per task in a mergeable frequent-item summary
    (Misra, Gries, "Finding repeated elements", 1982), whose error bound tells
    which tokens can be among the top ``k``; only these are then counted
    exactly, so neither shuffle carries more than the summaries. Where the
    bound is too wide for ``k`` (nothing stands out), all tokens are counted.
    The rows are the same either way.
    """
    tokens = df.select(F.explode(split_tokens(column, sep)).alias("__t"))
    tokens = tokens.select(normalize_key(F.col("__t")).alias(token_name)).where(F.col(token_name) != "")
    if summary and k is not None:
        found = frequent_candidates(tokens, token_name, k, summary)
        if found is not None:
            tokens = tokens.join(F.broadcast(found), token_name, "left_semi")
    out = (tokens.groupBy(token_name).agg(F.count(F.lit(1)).alias(count_name))
                 .orderBy(F.desc(count_name), F.asc(token_name)))
    return out.limit(k) if k is not None else out


# Fixed values of Spark's frequent-item summary: most items it reports, load and error of its hash table.
_REPORTED, _LOAD, _ERROR = 1024, 0.75, 3.5
#: Bytes of candidates that are sent at most.
_SENT = 8 << 20


def frequent_candidates(tokens: DataFrame, token: str, k: int, counters: int) -> DataFrame | None:
    """A column ``token`` with every value that can be among the ``k`` most frequent, or None if the summary can't tell.

    A summary of ``counters`` estimates each count at most ``error`` too high or too low, and misses no value of more than
    ``2 * error`` rows, ``error`` being a fixed share of all rows. So the k-th estimate less its error is a floor: what may
    reach it is a candidate, if the floor is above what a missed value can have.
    """
    reported = min(_REPORTED, counters)
    summary = tokens.agg(F.call_function("approx_top_k", F.col(f"`{token}`"), F.lit(reported), F.lit(counters)).alias("top"), F.count(token).alias("n"))
    rows = summary.select("n", F.posexplode_outer("top").alias("place", "item")).select("n", "place", "item.*").collect()
    estimates = [r["count"] for r in rows if r["count"] is not None]
    table = 1 << math.ceil(math.log2(counters / _LOAD))
    error = math.ceil(_ERROR / table * rows[0]["n"])
    if len(estimates) < k:
        return None
    floor = sorted(estimates, reverse=True)[k - 1] - error
    if floor <= 2 * error or (len(estimates) == reported and min(estimates) + error >= floor):
        return None
    names = [r["item"] for r in rows if r["count"] + error >= floor]
    if sum(len(n) for n in names) > _SENT // 4:
        return None
    return local_frame(tokens.sparkSession, [{token: n} for n in names], T.StructType([T.StructField(token, T.StringType())]))
