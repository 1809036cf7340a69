"""Order statistics by exact histograms (scans and small aggregates, no sort of the column).

Per group and wanted rank, a bracket of values is narrowed until it is one value or holds few rows:

1. Every value gets a bin that follows its sign and exponent (``BINS_PER_OCTAVE`` bins between powers of
   two). One aggregation counts each (group, bin) and keeps its least and greatest value; running counts over
   a group's bins tell which bin holds the rank. Counts are exact and merged by key, so no task merges more
   than its share of bins.
2. While a bracket has two different ends and more than ``FEW_ROWS`` rows, only its rows are binned again, in
   ``BINS`` equal parts from end to end. Both ends fall in different bins, so every pass narrows it; a bin with
   equal ends is done, however many rows hold that value.
3. What is left holds at most ``FEW_ROWS`` rows per bracket: they are counted by value, and running counts give
   the value at each rank.

The brackets of a few groups (or columns) are a small table that the driver holds and sends with each pass; a row finds
those of its group by a hash lookup. Beyond ``FEW_BRACKETS`` they are a stored table, so any number of groups works. Only
the bins that hold a wanted rank ever leave the executors.

The first pass can also tell count, mean, standard deviation and extremes: each bin keeps its mean and its sum of squared
deviations, which merge (Chan, Golub, LeVeque, "Updating formulae and a pairwise algorithm for computing sample
variances", 1979).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from realpay.functions.interpolation import lerp, lerp_value
from realpay.session import ensure_checkpoint_dir

BINS_PER_OCTAVE = 32
BINS = 1024
FEW_ROWS = 20_000
#: Rows of brackets that the driver holds at most.
FEW_BRACKETS = 2048
#: Bytes up to which a table of brackets is broadcast; beyond, Spark plans the join.
BROADCAST_BYTES = 8 * 1024 ** 2

_KEY = ["g", "lo", "hi"]


def broadcast_if_small(df: DataFrame, key: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, a key and a few numbers each, come to at most ``max_bytes``.
    For stored or small tables: it reads ``df`` once."""
    size = df.agg(F.sum(F.octet_length(F.col(key).cast("string")) + F.lit(16 * len(df.columns)))).first()[0]
    return F.broadcast(df) if (size or 0) <= max_bytes else df


def _first_bin(v: Column) -> Column:
    octave = F.floor(F.least(F.log2(F.abs(v)) * BINS_PER_OCTAVE, F.lit(1e5))) + 100_000
    return F.when(v == 0, F.lit(0)).when(v > 0, octave).otherwise(-octave)


def _next_bin(v: Column, lo: Column, hi: Column) -> Column:
    # halves, so that the width of the widest bracket does not overflow
    part = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    return F.least(F.floor(part * BINS), F.lit(BINS - 1))


def _running(partition: Sequence[str], order: str) -> Column:
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum("c").over(w) - F.col("c")


def _holds(before: str = "before", c: str = "c") -> Column:
    return (F.col(before) <= F.col("rank")) & (F.col("rank") < F.col(before) + F.col(c))


def _inside(base: DataFrame, brackets: DataFrame, size: int) -> DataFrame:
    own = brackets.select(*_KEY, "before").distinct().withColumnRenamed("g", "bg")
    own = F.broadcast(own) if size <= BROADCAST_BYTES else own
    return base.join(own, (F.col("g") == F.col("bg")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).drop("bg")


def _ranked(counted: DataFrame, brackets: DataFrame) -> DataFrame:
    """Counted bins of brackets with the wanted ranks that fall into each."""
    wanted = brackets.select(*_KEY, "p", "side", "rank", "h")
    return counted.join(wanted, _KEY).where(_holds())


def _checked(probs: Sequence[float]) -> list[float]:
    probs = [float(p) for p in probs]
    for p in probs:
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"probability out of range: {p}")
    return probs


def local_frame(spark: SparkSession, rows: Iterable, schema: T.StructType) -> DataFrame:
    """A few rows of the driver as a frame that takes no job to read."""
    rows = [r.asDict(recursive=True) if isinstance(r, Row) else r for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(schema)), schema)


def _literal(value: list, type_: str) -> Column:
    """Nested lists as one constant."""
    return F.from_json(F.lit(json.dumps(value)), type_)


_MOMENTS = ("n", "mean", "squares", "least", "most")


def first_bins(v: Column, moments: bool = True) -> tuple[Column, list[Column]]:
    """The bin of a value, and what the first pass keeps of a bin: ``c, lo, hi`` and, for moments, mean ``m`` and variance ``s``."""
    more = [F.avg(v).alias("m"), F.var_pop(v).alias("s")] if moments else []
    return _first_bin(v).alias("bin"), [F.count(v).alias("c"), F.min(v).alias("lo"), F.max(v).alias("hi"), *more]


def merged_bins(parts: DataFrame) -> DataFrame:
    """Rows of :func:`first_bins` that split bins further, put together to one per ``g`` and ``bin``."""
    whole = Window.partitionBy("g", "bin")
    parts = parts.where("c > 0").withColumn("mean", F.sum(F.col("m") * F.col("c")).over(whole) / F.sum("c").over(whole))
    off = F.when(F.col("m") == F.col("mean"), 0.0).otherwise(F.col("m") - F.col("mean"))
    return parts.groupBy("g", "bin").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("mean").alias("m"),
                                         (F.sum(F.col("c") * (F.col("s") + off * off)) / F.sum("c")).alias("s"))


def _first_pass(base: DataFrame, probs: Sequence[float], moments: bool = False, bins: DataFrame | None = None) -> DataFrame:
    """The bin of each wanted rank of each group ``g``, with its group's moments if they are asked for."""
    if bins is None:
        bin_, kept = first_bins(F.col("v"), moments)
        bins = base.groupBy("g", bin_).agg(*kept)
    whole = Window.partitionBy("g")
    bins = bins.select("*", _running(["g"], "bin").alias("before"), F.sum("c").over(whole).alias("n"))
    if moments:
        # deviations from a value of the column's own size lose no digits to it
        bins = bins.withColumns({"least": F.min("lo").over(whole), "most": F.max("hi").over(whole)})
        bins = bins.withColumn("off", F.when(F.abs("least") < float("inf"), F.col("m") - F.col("least")).otherwise(F.col("m")))
        bins = bins.withColumn("shift", F.sum(F.col("off") * (F.col("c") / F.col("n"))).over(whole))
        # a bin of one value has no spread, also if it is infinite
        spread = F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(F.col("s"))
        off = F.col("off") - F.col("shift")
        bins = bins.withColumns({"mean": F.col("shift") + F.when(F.abs("least") < float("inf"), F.col("least")).otherwise(0.0),
                                 "squares": F.sum(F.col("c") * (spread + off * off)).over(whole)})
    h = [(F.col("n") - 1).cast("double") * F.lit(p) for p in probs]
    wanted = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(side).alias("side"), end(x).cast("long").alias("rank"), x.alias("h"))
                       for i, x in enumerate(h) for side, end in ((0, F.floor), (1, F.ceil))])
    state = bins.select("g", "lo", "hi", "before", "c", *(_MOMENTS if moments else ()), F.inline(wanted)).where(_holds())
    return state.select("g", "p", "side", "rank", "h", "lo", "hi", "before", "c", *(_MOMENTS if moments else ()))


def _values(base: DataFrame, state: list[Row]) -> dict[tuple, float]:
    """The value at each (group, rank) of ``state``, the rows of :func:`_first_pass`."""
    at = {(r["g"], r["rank"]): (r["lo"], r["hi"], r["before"], r["c"]) for r in state}
    key = base.schema["g"].dataType
    v = F.col("v")

    def inside(brackets: list) -> DataFrame:
        """``i, lo, hi, v``: the rows in each bracket."""
        if isinstance(key, T.IntegerType):  # groups are numbers from 0: an array has the brackets of each
            of: list[list] = [[] for _ in range(1 + max(g for g, _ in brackets))]
            for i, (g, (lo, hi, _, _)) in enumerate(brackets):
                of[g].append({"i": i, "lo": lo, "hi": hi})
            own = F.filter(F.get(_literal(of, "array<array<struct<i: bigint, lo: double, hi: double>>>"), F.col("g")), lambda b: (v >= b["lo"]) & (v <= b["hi"]))
            return base.select(F.inline(own), "v")
        rows = [{"i": i, "bg": g, "lo": lo, "hi": hi} for i, (g, (lo, hi, _, _)) in enumerate(brackets)]
        own = local_frame(base.sparkSession, rows, T.StructType([T.StructField("i", T.LongType()), T.StructField("bg", key), T.StructField("lo", T.DoubleType()),
                                                                 T.StructField("hi", T.DoubleType())]))
        return base.join(F.broadcast(own), (F.col("g") == F.col("bg")) & (v >= F.col("lo")) & (v <= F.col("hi")))

    def narrowed(brackets: dict, by: Column) -> None:
        """Count the rows of each bracket by ``by`` and put the bins of its ranks in its place."""
        listed = list(brackets)
        bins = inside(listed).groupBy("i", by.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        first, ranks = _literal([b[2] for _, b in listed], "array<bigint>"), _literal(list(brackets.values()), "array<array<bigint>>")
        bins = bins.withColumn("ahead", _running(["i"], "bin")).withColumn("before", F.get(first, F.col("i").cast("int")) + F.col("ahead"))
        held = F.filter(F.get(ranks, F.col("i").cast("int")), lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("c")))
        for r in bins.select("i", "least", "most", "before", "c", F.explode(held).alias("rank")).collect():
            at[listed[r["i"]][0], r["rank"]] = (r["least"], r["most"], r["before"], r["c"])

    def open_(wide: bool) -> dict:
        out: dict[tuple, list] = {}
        for (g, rank), bracket in at.items():
            if bracket[0] < bracket[1] and (not wide or bracket[3] > FEW_ROWS):
                out.setdefault((g, bracket), []).append(rank)
        return out

    while wide := open_(True):
        narrowed(wide, _next_bin(F.col("v"), F.col("lo"), F.col("hi")))
    if few := open_(False):
        narrowed(few, F.col("v"))
    return {key: bracket[0] for key, bracket in at.items()}


def _interpolated(at: dict, g, h: float) -> float:
    low, high = at[g, math.floor(h)], at[g, math.ceil(h)]
    return low if math.floor(h) == math.ceil(h) else lerp_value(low, high, h - math.floor(h))


def _grouped(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str]) -> tuple[DataFrame, bool]:
    """:func:`order_statistics`, and whether its rows are few and came from the driver."""
    probs = _checked(probs)
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    v = F.col(value).cast("double")
    base = df.select(group.alias("g"), v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    state = _first_pass(base, probs)
    few = state.limit(FEW_BRACKETS + 1).collect()
    if len(few) > FEW_BRACKETS:
        return _many_groups(base, state, probs, by), False
    at = _values(base, few)
    rows = [{**{c: r["g"][c] for c in by}, "prob": probs[r["p"]], "value": _interpolated(at, r["g"], r["h"])} for r in few if r["side"] == 0]
    fields = [T.StructField(c, df.schema[c].dataType) for c in by]
    return local_frame(df.sparkSession, rows, T.StructType([*fields, T.StructField("prob", T.DoubleType()), T.StructField("value", T.DoubleType())])), True


def order_statistics(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by..., prob, value``: exact quantiles with linear interpolation, rounded as ``quantile_cont`` does.

    NULL and NaN values are skipped; a NULL group key is a group; a group without values has no rows. Runs a few
    aggregations over ``df`` now (it is read once per pass, so store it first if it is dear to compute).
    """
    return _grouped(df, value, probs, by)[0]


def _many_groups(base: DataFrame, state: DataFrame, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Brackets of any number of groups, as a stored table that is joined by group."""
    ensure_checkpoint_dir(base.sparkSession)
    state = state.checkpoint()
    open_ = F.col("lo") < F.col("hi")
    wide = open_ & (F.col("c") > FEW_ROWS)

    def look():
        """Whether a bracket is wide, and the bytes of the open ones."""
        each = F.octet_length(F.col("g").cast("string")) + F.lit(64)
        return state.agg(F.max(wide), F.coalesce(F.sum(F.when(open_, each)), F.lit(0))).first()

    while (seen := look())[0]:
        left = state.where(wide)
        rows = _inside(base, left, seen[1])
        bins = rows.groupBy(*_KEY, "before", _next_bin(F.col("v"), F.col("lo"), F.col("hi")).alias("bin")).agg(
            F.count(F.lit(1)).alias("c"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi"))
        bins = bins.withColumn("before", F.col("before") + _running(_KEY, "bin"))
        new = _ranked(bins, left).select("g", "p", "side", "rank", "h", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), "before", "c")
        state = state.where(~wide).unionByName(new).checkpoint()

    values = _inside(base, state.where(open_), seen[1]).groupBy(*_KEY, "before", "v").agg(F.count(F.lit(1)).alias("c"))
    values = values.withColumn("before", F.col("before") + _running(_KEY, "v"))
    picked = _ranked(values, state.where(open_)).select("g", "p", "side", "h", "v")
    picked = picked.unionByName(state.where(~open_).select("g", "p", "side", "h", F.col("lo").alias("v")))
    ends = picked.groupBy("g", "p").agg(F.first("h").alias("h"), F.max(F.when(F.col("side") == 0, F.col("v"))).alias("a"),
                                        F.max(F.when(F.col("side") == 1, F.col("v"))).alias("b"))
    between = lerp(F.col("a"), F.col("b"), F.col("h") - F.floor("h"))
    found = F.when(F.floor("h") == F.ceil("h"), F.col("a")).otherwise(between)
    prob = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("p") + 1)
    return ends.select(*[F.col("g")[c].alias(c) for c in by], prob.alias("prob"), found.alias("value"))


@dataclass(frozen=True)
class Summary:
    """What :func:`column_summaries` tells of a column. ``std`` is that of a sample; without values all but n is None."""

    n: int
    mean: float | None
    std: float | None
    least: float | None
    most: float | None
    quantiles: tuple[float | None, ...]


def column_summaries(df: DataFrame, values: Sequence[str], probs: Sequence[float], moments: bool = True, bins: DataFrame | None = None) -> list[Summary]:
    """Count, mean, standard deviation, extremes (unless ``moments`` is off: None) and quantiles of whole columns.

    The same passes as :func:`order_statistics`, the columns being its groups: all columns in one pass, a cell meets
    the brackets of its own column only. ``bins`` saves the first pass: rows of :func:`first_bins` by ``g`` (a column's
    place, from 0) and ``bin``.
    """
    probs = _checked(probs)
    cells = [F.struct(F.lit(k).alias("g"), F.col(f"`{c}`").cast("double").alias("v")) for k, c in enumerate(values)]
    base = df.select(F.inline(F.array(*cells))) if len(cells) > 1 else df.select(cells[0]["g"].alias("g"), cells[0]["v"].alias("v"))
    base = base.where(F.col("v").isNotNull() & ~F.isnan("v"))
    state = _first_pass(base, probs, moments, bins).collect()
    at = _values(base, state)
    rows = {r["g"]: r for r in state}
    wanted = {(r["g"], r["p"]): _interpolated(at, r["g"], r["h"]) for r in state if r["side"] == 0}
    out = []
    for k in range(len(values)):
        quantiles = tuple(wanted.get((k, i)) for i in range(len(probs)))
        if k not in rows or not moments:
            out.append(Summary(0, None, None, None, None, quantiles))
            continue
        n, mean, squares, least, most = (rows[k][c] for c in _MOMENTS)
        out.append(Summary(n, mean, math.sqrt(squares / (n - 1)) if n > 1 else None, least, most, quantiles))
    return out


def column_quantiles(df: DataFrame, values: Sequence[str], probs: Sequence[float]) -> list[list[float | None]]:
    """Quantiles of whole columns as Python floats, a list per column (``None`` where it has no values)."""
    return [list(s.quantiles) for s in column_summaries(df, values, probs, moments=False)]


def global_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> list[float | None]:
    """:func:`column_quantiles` of one column."""
    return column_quantiles(df, [value], probs)[0]


def grouped_quantiles(df: DataFrame, group: str, value: str, probs: Sequence[float]) -> DataFrame:
    """``group, q0, q1, ...``: one row per group, a column per probability in the order given."""
    return fenced_groups(df, group, value, probs)[0]


def fenced_groups(df: DataFrame, group: str, value: str, probs: Sequence[float]) -> tuple[DataFrame, bool]:
    """:func:`grouped_quantiles`, and whether its rows are few and came from the driver."""
    probs = [float(p) for p in probs]
    long, few = _grouped(df, value, sorted(set(probs)), [group])
    if not few:
        return long.groupBy(group).agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"q{i}") for i, p in enumerate(probs)]), False
    by: dict = {}
    for r in long.collect():
        by.setdefault(r[group], {})[r["prob"]] = r["value"]
    rows = [{group: g, **{f"q{i}": found[p] for i, p in enumerate(probs)}} for g, found in by.items()]
    schema = T.StructType([T.StructField(group, df.schema[group].dataType), *(T.StructField(f"q{i}", T.DoubleType()) for i in range(len(probs)))])
    return local_frame(df.sparkSession, rows, schema), True


def quantile_frame(df: DataFrame, value: str, probs: Sequence[float], method: str = "exact") -> DataFrame:
    """Global quantiles as a ``prob, value`` frame, a row per probability also for a column without values."""
    from realpay.operators.quantiles import exact_quantiles

    if method != "exact":
        return exact_quantiles(df, value, probs, method=method)
    probs = [float(p) for p in probs]
    return df.sparkSession.createDataFrame(list(zip(probs, global_quantiles(df, value, probs))), "prob double, value double")
