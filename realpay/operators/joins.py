"""LEFT join of a fact table to a dimension on normalised (trimmed) keys."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from realpay.functions.text import normalize_key
from realpay.operators.materialize import materialize

_DK = "__dim_key"
#: Stand-in keys of rows without key.
_STAND_INS = 4096


def join_dimension(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
                   columns: Mapping[str, str],
                   normalize: Callable[[Column], Column] = normalize_key, split_hot: bool = False) -> DataFrame:
    """``SELECT f.*, d.col AS alias.. FROM facts f LEFT JOIN dim d ON
    normalize(f.key) = normalize(d.key)``.

    Every fact row is kept; unmatched rows and NULL keys get NULL dimension
    columns; a dimension with duplicate normalised keys fans out, as in SQL.
    Only the key and the requested columns of the dimension are read. Facts may
    have columns of any type.

    Spark picks the join from its size statistics, and AQE from the sizes at
    run time: a small dimension is broadcast, else both sides are shuffled. A
    fact row without key can match nothing; it gets one of many stand-in keys,
    so such rows do not meet in one partition.

    ``split_hot`` is for dimensions too large to broadcast, where a hot key's
    rows would meet in one task (AQE splits them where it is on). The keys are
    counted first (one scan of the key column): a key with more rows than a
    shuffle partition's even share is dealt by a salt, and its dimension rows
    are repeated for each.
    """
    d = dim.select(normalize(F.col(f"`{dim_key}`")).alias(_DK),
                   *[F.col(f"`{src}`").alias(alias) for alias, src in columns.items()])
    d = d.where(F.col(_DK).isNotNull())
    key = normalize(F.col(f"`{fact_key}`"))
    spread = F.concat(F.lit("\0"), F.floor(F.rand(_STAND_INS) * _STAND_INS).cast("string"))
    keyed = facts.withColumns({_DK + "_n": key.isNull(), _DK + "_f": F.coalesce(key, spread)})
    # the stand-in of a missing key must not match a dimension key that looks like it
    side = d.withColumn(_DK + "_d", F.lit(False))
    on = [F.col(_DK + "_f") == F.col(_DK), F.col(_DK + "_n") == F.col(_DK + "_d")]
    if split_hot:
        hot = hot_keys(facts.select(key.alias(_DK + "_h")), _DK + "_h", _DK + "_s")
        keyed = (keyed.join(F.broadcast(hot), keyed[_DK + "_f"] == hot[_DK + "_h"], "left")
                 .withColumn(_DK + "_p", F.floor(F.rand(_STAND_INS) * F.coalesce(_DK + "_s", F.lit(1)))).drop(_DK + "_h", _DK + "_s"))
        side = (side.join(F.broadcast(hot), side[_DK] == hot[_DK + "_h"], "left")
                .withColumn(_DK + "_q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(_DK + "_s", F.lit(1)) - 1))).drop(_DK + "_h", _DK + "_s"))
        on.append(F.col(_DK + "_p") == F.col(_DK + "_q"))
    return keyed.join(side, on, "left").select(*[F.col(f"`{c}`") for c in facts.columns], *columns)


def hot_keys(keys: DataFrame, key: str, shares: str) -> DataFrame:
    """``key, shares`` of the keys with more rows than an even share of a shuffle partition, and over how many such
    shares they go. There are fewer of them than shuffle partitions, so they may be broadcast. Counted now."""
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = materialize(keys.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")))
    share = max(1, (counted.agg(F.sum("__n")).first()[0] or 0) // partitions)
    return counted.where(F.col("__n") > share).select(key, F.ceil(F.col("__n") / share).cast("bigint").alias(shares))
