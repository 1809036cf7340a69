"""CSV reading with pandas-style missing-value tokens.

pandas ``read_csv`` treats a family of strings (``NA``, ``null``, ``n/a``,
``NaN``, empty, ...) as missing; Spark's CSV reader only the empty field. The
reader below reads every field as written and turns the tokens into NULL before casting, so a token never becomes a
parse error under ANSI mode.

What can't be placed is refused, as pandas refuses it: a file whose header differs from the others', a record with more
fields than the header, and a quoted line break where lines are read one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from realpay.functions.numbers import NUMBER_PATTERN, strict_number

# pandas' default NA strings.
DEFAULT_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def tokens_to_null(c: Column, na_tokens=DEFAULT_NA_TOKENS) -> Column:
    """NULL when the raw field equals one of ``na_tokens`` (exact match, as
    pandas compares the unstripped field)."""
    return F.when(~c.isin(list(na_tokens)), c)


# Fixed value: whole numbers as pandas reads them into int64 (optional sign,
# digits, surrounding blanks).
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"


# Fixed value: what pandas reads into bool.
BOOLEAN_PATTERN = "^(True|TRUE|true|False|FALSE|false)$"


def infer_types(raw: DataFrame) -> T.StructType:
    """Column types as ``read_csv`` infers them, decided in ONE aggregation:
    a column whose non-missing values are all truth values becomes boolean, all whole numbers of 64 bits bigint,
    all numbers (see ``strict_number``) double, anything else string; a
    column with no values at all is double (pandas: all-NaN float64)."""
    aggs = []
    for i, name in enumerate(raw.columns):
        c = F.col(f"`{name}`")
        aggs += [F.count(c).alias(f"n{i}"), F.count_if(c.rlike(INTEGER_PATTERN)).alias(f"i{i}"),
                 F.count_if(c.rlike(NUMBER_PATTERN)).alias(f"d{i}"),
                 F.count(F.trim(c).try_cast("bigint")).alias(f"l{i}"), F.count_if(c.rlike(BOOLEAN_PATTERN)).alias(f"b{i}")]
    row = raw.agg(*aggs).first()
    fields = []
    for i, name in enumerate(raw.columns):
        n, ints, nums = row[f"n{i}"], row[f"i{i}"], row[f"d{i}"]
        if n == 0 or (nums == n and ints < n):
            dtype = T.DoubleType()
        elif ints == n:  # beyond 64 bits: a number still, as a double
            dtype = T.LongType() if row[f"l{i}"] == n else T.DoubleType()
        elif row[f"b{i}"] == n:
            dtype = T.BooleanType()
        else:
            dtype = T.StringType()
        fields.append(T.StructField(name, dtype, True))
    return T.StructType(fields)


def _typed(c: Column, name: str, dtype: T.DataType, lenient: bool) -> Column:
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # infinity and nan have no digits to lose: only text that is no number at all is bad
        value, bad = strict_number(c).cast(dtype), ~c.rlike(NUMBER_PATTERN) & (F.lower(F.trim(c)) != "nan")
    else:
        value = F.trim(c).try_cast(dtype)
        bad = c.isNotNull() & value.isNull()
    if lenient:
        return value
    return F.when(bad, F.raise_error(F.concat(F.lit(f"column {name}: not a {dtype.simpleString()}: "), c)).cast(dtype)).otherwise(value)


#: Column of the records that Spark's reader finds malformed.
_BAD = "__bad_record"
#: Stands for no value at all, so that an empty field stays an empty text.
_NO_NULL = "\0"
#: A field put behind a record.
_BEHIND = "\1"


def _column_names(header: list[str | None]) -> list[str]:
    """Names as pandas gives them: ``Unnamed: 2`` for none, ``id``, ``id.1``, ... for repeated ones."""
    out: list[str] = []
    for i, name in enumerate(header):
        name = own = f"Unnamed: {i}" if name in (None, "") else name
        k = 0
        while name in out or (k and name in header):
            k += 1
            name = f"{own}.{k}"
        out.append(name)
    return out


def _fields(line: Column, n: int) -> list[Column]:
    """The first ``n`` fields of a record, NULL where it has fewer."""
    record = F.from_csv(line, ", ".join(f"c{i} string" for i in range(n)), {"escape": '"', "nullValue": _NO_NULL,
                                                                          "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    return [record[f"c{i}"] for i in range(n)]


def _refuse_lines(spark: SparkSession, path: str, header: list[str] | None, quotes: bool) -> None:
    """Raise if a line has an odd number of quotes (a quoted line break), or a file does not have ``header``. One scan."""
    lines = spark.read.text(path)
    odd = (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))) % 2 == 1
    checks = [F.min(F.when(F.lit(quotes) & odd, F.substring("value", 1, 80))).alias("odd")]
    if header is None:
        found = lines.agg(*checks).first()
    else:
        same = [F.coalesce(field, F.lit("")) == F.lit(name or "") for field, name in zip(_fields(F.col("value"), len(header)), header)]
        own = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(*checks, F.bool_or(F.array_min(F.array(*same))).alias("same"))
        found = own.agg(F.min("odd").alias("odd"), F.min(F.when(~F.col("same"), F.col("file"))).alias("other")).first()
        if found["other"]:
            raise ValueError(f"{found['other']}: its header differs from that of other files")
    if found["odd"]:
        raise ValueError(f"{path}: a quoted field goes on behind the end of its line; read with multi_line=True: {found['odd']}")


def _records(spark: SparkSession, path: str, header: bool, lenient: bool, multi_line: bool) -> DataFrame:
    """All fields as text. A record with more fields than the header is an error when it is read, unless ``lenient``."""
    reader = (spark.read.option("inferSchema", False).option("escape", '"').option("multiLine", multi_line).option("nullValue", _NO_NULL)
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    first = reader.option("header", False).csv(path).first()
    if first is None:
        raise ValueError(f"{path} has no columns")
    names = _column_names(list(first)) if header else [f"_c{i}" for i in range(len(first))]
    renamed = header and names != list(first)
    if not lenient or renamed:
        _refuse_lines(spark, path, list(first) if renamed else None, not multi_line and not lenient)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, _BAD)])
    # Spark compares each file's header with the schema; renamed columns were compared above
    raw = (reader.option("header", header).option("enforceSchema", renamed).option("columnPruning", False)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).schema(schema).csv(path))
    if not lenient:
        # a record is also malformed with fewer fields: those are missing values, as in pandas. Fields put behind it tell
        # which it is, as the last column is one of them only then
        last = _fields(F.concat(_BAD, F.lit(f",{_BEHIND}" * len(names))), len(names))[-1]
        more = F.coalesce(last != _BEHIND, F.lit(True))
        message = F.concat(F.lit(f"{path}: expected {len(names)} fields, saw more, in the record that begins with "), F.coalesce(f"`{names[0]}`", F.lit("nothing")),
                           F.lit(": "), F.substring(_BAD, 1, 200))
        raw = raw.where(F.coalesce(F.when(F.col(_BAD).isNotNull() & more, F.raise_error(message).cast("boolean")), F.lit(True)))
    return raw.drop(_BAD)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               na_tokens=DEFAULT_NA_TOKENS, header: bool = True, lenient: bool = False,
               multi_line: bool = False) -> DataFrame:
    """Read a delimited file into ``schema``, its columns found by their names in the header (by position
    without header); a column that is not there is an error.

    Every field is read as text, with doubled quotes inside quotes. NA tokens become NULL. Float columns take
    pandas' number syntax (``strict_number``), other typed columns what casts to them. A value that is neither
    is an error, or NULL with ``lenient``. ``multi_line`` allows line breaks inside quotes; a file is then read by
    one task, as its lines can't be told apart elsewhere.

    Refused are a file with another header than the others (when it is read), a record with more fields than the
    header (when it is read; with ``lenient`` the rest is left out), and, without ``multi_line``, a line with an odd
    number of quotes (now, by one scan of the lines; not with ``lenient``). A record with fewer fields has NULL in
    the rest. Columns without a name, or with one that stood before, are named as pandas names them.

    Without ``schema`` the types come from :func:`infer_types` (one aggregation over the cleaned text).
    """
    raw = _records(spark, path, header, lenient, multi_line)
    if schema is not None and not header:
        raw = raw.toDF(*[f.name for f in schema][:len(raw.columns)])
    if schema is not None:
        missing = [f.name for f in schema if f.name not in raw.columns]
        if missing:
            raise ValueError(f"{path} has no column {', '.join(missing)}")
    cleaned = raw.select(*[tokens_to_null(F.col(f"`{c}`"), na_tokens).alias(c) for c in raw.columns])
    schema = schema or infer_types(cleaned)
    return cleaned.select(*[_typed(F.col(f"`{f.name}`"), f.name, f.dataType, lenient).alias(f.name) for f in schema])
