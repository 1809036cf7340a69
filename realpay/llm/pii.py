"""Personal data: fixed forms, and further identifiers learned from the words around them.

Bootstrapping (as in Snowball, Agichtein and Gravano, 2000): the spans of the fixed forms are seeds. The
words around a seed induce lexical patterns. Each round scores the graph of patterns and instances: a pattern
by the known instances of one kind that it extracts against those that are of another kind or can't be of this
one, an instance by all trusted patterns that extract it. What may be of the kind but is not known yet counts
neither way. Instances that pass are known in the next round, until a round adds none.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from realpay.llm.tables import stored

KINDS = ("email", "ip", "card", "phone")

#: Share of known instances among these and the negative ones (one more counted) from which a pattern is trusted:
#: without negative ones it takes four.
PATTERN_CONFIDENCE = 0.8
#: Score from which an instance is known: it takes two trusted patterns, or one that is nearly sure.
INSTANCE_CONFIDENCE = 0.9
#: Characters on either side in which context words are looked for.
REACH = 80
#: Rows that one step works on.
STEP_ROWS = 500

# An email's local part is found backwards from its @, which has the same result as a scan from the left:
# the run before @ holds no @. No search below starts twice in the same run, so all are linear.
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# What may be an identifier without having a fixed form, and the kinds that each may be of.
_LOOSE = (
    (re.compile(r"(?<![\w+])[(]?[0-9](?:[\x20().-]{0,3}[0-9])+(?!\w)"), None),
    (re.compile(r"(?<!\S)[^\s@]{1,64}@[^\s@]{1,255}"), ("email",)),
    (re.compile(r"(?<![\w:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![\w:])"), ("ip",)),
)
_TRIM = ".,;:!?\"'()[]{}<>"


def _luhn(digits: str) -> bool:
    double = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (double + sum(map(int, digits[-1::-2]))) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            free = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind in KINDS, start, end) in code points, by kind, then start."""
    if not _HINT.search(text):
        return []
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split("."))]
    for kind, form, low, high in ((2, _CARD, 16, 19), (3, _PHONE, 8, 15)):
        for m in form.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if low <= len(digits) <= high and (kind == 3 or _luhn(digits)):
                out.append((kind, *m.span()))
    return out


def _loose_spans(text: str, taken: list) -> list[tuple[int, int, list[str]]]:
    """Spans that may be identifiers and touch none of the base spans, with the kinds they may be of; after these,
    numbers that can't be of any."""
    apart = _Apart()
    for _, start, end in taken:
        apart.add(start, end)
    out, others, found = [], [], _Apart()
    for form, kinds in _LOOSE:
        for m in form.finditer(text):
            start, end = m.span()
            while end > start and text[end - 1] in _TRIM:
                end -= 1
            digits = len(_NOT_DIGIT.sub("", text[start:end]))
            of = kinds or [k for k, ok in (("card", 13 <= digits <= 19), ("phone", 7 <= digits <= 15)) if ok]
            if end > start and apart.free(start, end) and found.free(start, end):
                if of:
                    found.add(start, end)
                (out if of else others).append((start, end, list(of)))
    return out + [x for x in others if found.free(x[0], x[1])]


class _Apart:
    """Spans put together where they overlap, in order, so that a look takes a binary search."""

    def __init__(self):
        self.starts, self.ends = [], []

    def free(self, start: int, end: int) -> bool:
        """Whether no span overlaps start:end."""
        i = bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start

    def add(self, start: int, end: int) -> None:
        high = bisect_left(self.starts, end)
        low = bisect_right(self.ends, start, 0, high)
        if low < high:
            start, end = min(start, self.starts[low]), max(end, self.ends[high - 1])
        self.starts[low:high], self.ends[low:high] = [start], [end]


def _patterns(text: str, start: int, end: int) -> list[str]:
    left = [w.strip(_TRIM).lower() for w in text[max(0, start - REACH) : start].split()[-2:]]
    right = [w.strip(_TRIM).lower() for w in text[end : end + REACH].split()[:2]]
    out = []
    if len(left) == 2 and all(left):
        out.append(f"{left[0]} {left[1]} _")
    if left and right and left[-1] and right[0]:
        out.append(f"{left[-1]} _ {right[0]}")
    if len(right) == 2 and all(right):
        out.append(f"_ {right[0]} {right[1]}")
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SEEN = pa.struct([("instance", pa.string()), ("kind", pa.string()), ("may_be", pa.list_(pa.string())), ("start", pa.int64()), ("end", pa.int64()), ("patterns", pa.list_(pa.string()))])
_ROWS = pa.schema([("id", pa.int64()), ("base", pa.list_(_SPAN)), ("seen", pa.list_(_SEEN))])
_ROWS_SQL = ("id long, base array<struct<kind: string, start: long, end: long>>, seen array<struct<instance: string, kind: string, "
             "may_be: array<string>, start: long, end: long, patterns: array<string>>>")


def _rows(batches):
    for batch in batches:
        for low in range(0, len(batch), STEP_ROWS):
            part = batch.slice(low, STEP_ROWS)
            base, seen = [], []
            for text in part.column(1).to_pylist():
                own = base_spans(text) if text else []
                base.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in own])
                found = [(s, e, KINDS[k], None) for k, s, e in own]
                if text and _HINT.search(text):
                    found += [(s, e, None, of) for s, e, of in _loose_spans(text, own)]
                seen.append([{"instance": text[s:e].lower(), "kind": k, "may_be": of, "start": s, "end": e, "patterns": _patterns(text, s, e)} for s, e, k, of in found])
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(base, _ROWS.field(1).type), pa.array(seen, _ROWS.field(2).type)], schema=_ROWS)


def learned(seen: DataFrame) -> DataFrame:
    """``instance, kind`` of the identifiers without a fixed form that the patterns vouch for.

    ``seen``: ``instance, kind`` (null if not a seed), ``may_be, pattern``, one row per place. Places are
    combined to distinct links first, so copies of a text add neither weight nor work.
    """
    links = stored(seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.max("may_be").alias("may_be")), "links")
    known = stored(links.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("known"), F.lit(True).alias("seed")), "known")
    while True:
        by_kind = [F.count_if(F.col("known") == k).alias(k) for k in KINDS]
        against = [F.count_if(F.coalesce(F.col("known") != k, ~F.array_contains("may_be", k))).alias(f"not_{k}") for k in KINDS]
        counts = links.join(known, "instance", "left").groupBy("pattern").agg(*by_kind, *against)
        best = F.array_max(F.array(*(F.struct((F.col(k) / (F.col(k) + F.col(f"not_{k}") + 1)).alias("confidence"), F.lit(k).alias("kind")) for k in KINDS)))
        trusted = counts.select("pattern", best.kind.alias("as_kind"), best.confidence.alias("confidence")).where(F.col("confidence") >= PATTERN_CONFIDENCE)
        vouched = links.where("kind is null").join(trusted, "pattern").where("array_contains(may_be, as_kind)")
        scores = vouched.groupBy("instance", "as_kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        new = scores.where(F.col("score") >= INSTANCE_CONFIDENCE).groupBy("instance").agg(F.max(F.struct("score", "as_kind")).alias("best"))
        new = stored(new.select("instance", F.col("best.as_kind").alias("known"), F.lit(False).alias("seed")).join(known, "instance", "left_anti"), "learned")
        if new.isEmpty():
            return known.where("not seed").drop("seed")
        known = stored(known.unionByName(new), "known")


def _added(rows: DataFrame) -> DataFrame:
    """``row, added``: the spans of each row that the patterns add."""
    seen = rows.where(F.size("seen") > 0).select("row", F.explode("seen").alias("s")).select("row", "s.*")
    seen = stored(seen, "seen")
    new = learned(seen.select("instance", "kind", "may_be", F.explode("patterns").alias("pattern")))
    places = seen.where("kind is null").join(new, "instance").select("row", F.struct(F.col("known").alias("kind"), "start", "end").alias("span"))
    return places.groupBy("row").agg(F.collect_list("span").alias("added"))


def _found(docs: DataFrame, id_column) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(id_column.cast("long").alias("id"), "text").mapInArrow(_rows, _ROWS_SQL)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "spans")
    return rows, stored(_added(rows), "added")


def _as_text(spans):
    order = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda x: F.struct(F.array_position(order, x.kind).alias("k"), x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """The personal data in each row of ``docs`` (``doc_id, text``).

    Returns ``doc_id``, ``n_email, n_ip, n_card, n_phone`` and ``base_sha256`` for the fixed forms, and
    ``spans``, which also lists what the patterns added: kind:start:end by kind, then start, in code points.
    A null or empty text has none. Every row gives one row, also if its doc_id is null or repeats. Other
    columns are ignored.
    """
    rows, added = _found(docs, F.col("doc_id"))
    out = rows.join(added, "row", "left")
    counts = [F.expr(f"size(filter(base, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    spans = F.concat("base", F.coalesce("added", F.slice("base", 1, 0)))
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(_as_text(F.col("base")), 256).alias("base_sha256"), _as_text(spans).alias("spans"))


def _redacted(text: str | None, added: list | None) -> str | None:
    if not text:
        return text
    spans = sorted([(s, e, KINDS[k]) for k, s, e in base_spans(text)] + [(x["start"], x["end"], x["kind"]) for x in added or []])
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:] if out else text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind, as ``[EMAIL]``.

    Overlapping spans become one, named by the first. ``n_chars`` follows the new text, if there is one. Rows
    and other columns stay as they are.
    """
    key = F.xxhash64("doc_id", "text")
    rows, added = _found(docs, key)
    added = stored(rows.join(added, "row").groupBy(F.col("id").alias("_rp_key")).agg(F.first("added").alias("_rp_added")), "added_by_key")
    none = F.array().cast("array<struct<kind: string, start: long, end: long>>")
    out = docs.join(added, key == added["_rp_key"], "left").select(*docs.columns, F.coalesce("_rp_added", none).alias("_rp_added"))

    def replaced(batches):
        for batch in batches:
            for low in range(0, len(batch), STEP_ROWS):
                part = batch.slice(low, STEP_ROWS)
                texts = [_redacted(t, a) for t, a in zip(part.column("text").to_pylist(), part.column("_rp_added").to_pylist())]
                at = part.schema.get_field_index("text")
                yield part.drop_columns(["_rp_added"]).set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    out = out.mapInArrow(replaced, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
