"""Repeated passages, found with suffix arrays, removed from all places but the first.

Every string of LENGTH bytes (a window) holds the same GRAM-byte string with the least hash wherever the
window stands: its anchor. Windows in a row with the same anchor are a run, and only runs with the same anchor
can share a window. So runs are dealt by anchor. Equal runs need no sorting: all but the first repeat it. The
texts of the different runs of an anchor, which differ around it, get a suffix array by two-stage sorting (Itoh
and Tanaka, 1999): only suffixes smaller than their successors are sorted directly, the rest is induced by
scans of the buckets. Adjacent suffixes with a common prefix of LENGTH bytes are the same window.

A line that stands in very many different contexts is one anchor of very many different runs. Such runs are cut
into shorter pieces, dealt by the bytes that all windows of a piece share; a key that is still too large for one
array is handed back and cut again, down to single windows.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from realpay.llm.tables import shuffle_partitions, stored
from realpay.llm.textbytes import mix, prefix_sums, range_hashes, sliding_min, steps

LENGTH = 100
GRAM = 32
#: Bytes of one text that are worked on at once; positions in them take 20 bits.
SLICE = 1 << 19
_POSITION = np.uint64((1 << 20) - 1)
#: Runs of which a partition drops those equal to an earlier one before it hands them on.
HELD_RUNS = 1 << 20
#: How many places of the anchor the windows of a piece may have: runs are uncut (0) first, then cut in turn.
CUTS = (0, 16, 4, 1)
#: One document in so many is looked at to find the anchors of very many runs.
LOOK = 16


class Bounds(NamedTuple):
    """What one task holds at once. The result is the same for all values.

    crowd: runs of an anchor beyond which they are cut as the second of CUTS says; as the third and fourth beyond
    256 and 4,096 times as many. key_bytes: pieces of one key beyond which these are cut again. array_bytes: one
    suffix array, about. hot: runs of an anchor among the documents looked at, beyond which its runs are
    salted.
    """

    crowd: int = 4096
    key_bytes: int = 1 << 20
    array_bytes: int = 1 << 19
    hot: int = 256

    def cut(self, crowd: int) -> int:
        return CUTS[sum(crowd > self.crowd * times for times in (1, 1 << 8, 1 << 12))]


# -- runs of windows


def _runs(data: np.ndarray, offsets: np.ndarray):
    """Of each run: its row, its first window's start in the row, the number of windows, where in the first
    window the anchor stands, the anchor's hash, and a hash of the run's bytes. All rows together take 20 bits."""
    if len(data) < LENGTH:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    sums = prefix_sums(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = range_hashes(sums, at, at + GRAM)
    least = sliding_min(grams & ~_POSITION | at.astype(np.uint64), LENGTH - GRAM + 1)
    anchor = (least & _POSITION).astype(np.int64)
    inside = (np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)] - np.arange(len(anchor))) >= LENGTH
    new = np.diff(anchor, prepend=-1) != 0
    first = np.flatnonzero(inside & (new | ~np.append(False, inside[:-1])))
    last = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    row = np.searchsorted(offsets, first, "right") - 1
    return [row, first - offsets[row], last - first + 1, anchor[first] - first, grams[anchor[first]], range_hashes(sums, first, last + LENGTH)]


def _slices(data: np.ndarray, offsets: np.ndarray):
    """:func:`_runs` of a step, which is one row if it is longer than SLICE."""
    if len(data) <= SLICE:
        yield _runs(data, offsets)
        return
    for low in range(0, len(data) - LENGTH + 1, SLICE):
        part = data[low : low + SLICE + LENGTH - 1]
        runs = _runs(part, np.array([0, len(part)]))
        runs[1] += low
        yield runs


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """The union of the ranges of each document."""
    order = np.lexsort([start, doc])
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    # ranges of a document lie within 2**40 bytes; apart, documents don't touch
    number = np.cumsum(np.diff(doc, prepend=doc[0]) != 0) << 40
    reach = np.maximum.accumulate(number + end)
    new = np.append(True, number[1:] + start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.append(reach[first[1:] - 1], reach[-1]) - number[first]


_RUN_SQL = "anchor long, same long, id long, place long"
_RUN = pa.schema([("anchor", pa.int64()), ("same", pa.int64()), ("id", pa.int64()), ("place", pa.int64())])


def _held(parts: list) -> pa.RecordBatch:
    """Runs that no earlier one here is equal to; and, with ``same`` null, the spans of the others (the end as
    ``anchor``).

    ``place``: the first window's start, the number of windows, and where in it the anchor stands, 8 bits each
    of the latter.
    """
    doc, start, n, ahead, anchor, text = (np.concatenate([p[i] for p in parts]) for i in range(6))
    order = np.lexsort([start, doc])
    doc, start, n, ahead, anchor, text = (x[order] for x in (doc, start, n, ahead, anchor, text))
    place = start << 16 | n << 8 | ahead
    same = mix(text ^ mix(anchor ^ (n << 8 | ahead).astype(np.uint64)))
    _, first = np.unique(same, return_index=True)
    again = np.ones(len(doc), bool)
    again[first] = False
    spans = _merged(doc[again], start[again], (start + n - 1 + LENGTH)[again])
    none = pa.nulls(len(spans[0]), pa.int64())
    runs = [pa.array(x[first].view(np.int64)) for x in (anchor, same, doc, place)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(runs, [pa.array(spans[2]), none, pa.array(spans[0]), pa.array(spans[1])])], schema=_RUN)


def _all_runs(batches):
    parts, held = [], 0
    for rows, data, offsets in steps(batches):
        ids = rows.column("id").to_numpy()
        for row, *rest in _slices(data, offsets):
            parts.append([ids[row], *rest])
            held += len(row)
        if held >= HELD_RUNS:
            yield _held(parts)
            parts, held = [], 0
    if held:
        yield _held(parts)


# -- suffix arrays


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The suffixes of ``text`` (uint8) in the order of their first ``depth`` bytes, by two-stage sorting."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # a suffix is smaller than its successor if the first different byte after it is larger
    step = np.append(np.diff(text.astype(np.int16)), -1)
    decides = np.where(step != 0, np.arange(n), n)
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    smaller = np.flatnonzero(step[decides] > 0)
    padded = np.append(text, np.zeros(depth, np.uint8))
    heads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[smaller]).view(f"S{depth}").ravel()
    direct = smaller[np.argsort(heads, kind="stable")]
    bounds = np.searchsorted(text[direct], np.arange(257))
    buckets: list[list] = [[] for _ in range(256)]
    buckets[text[-1]].append(np.array([n - 1]))
    out = []

    def induce(scanned: np.ndarray, byte: int) -> np.ndarray:
        """Hand the larger predecessors to their buckets; those of the same byte are returned."""
        before = scanned[scanned > 0] - 1
        first = text[before]
        larger = before[first > byte]
        larger = larger[np.argsort(text[larger], kind="stable")]
        cuts = np.flatnonzero(np.diff(text[larger])) + 1
        for group in np.split(larger, cuts) if len(larger) else ():
            buckets[text[group[0]]].append(group)
        return before[first == byte]

    for byte in range(256):
        wave = np.concatenate(buckets[byte]) if buckets[byte] else direct[:0]
        while len(wave):
            out.append(wave)
            wave = induce(wave, byte)
        own = direct[bounds[byte] : bounds[byte + 1]]
        if len(own):
            out.append(own)
            induce(own, byte)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Bytes, ``most`` at most, that each suffix of ``order`` has in common with the next."""
    padded = np.append(text, np.zeros(most + 8, np.uint8))
    word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").ravel().astype(np.uint64)
    out = np.zeros(max(len(order) - 1, 0), np.int64)
    left = np.arange(len(out))
    for done in range(0, most, 8):
        differ = word[order[left] + done] ^ word[order[left + 1] + done]
        out[left] += sum((differ >> np.uint64(8 * k)) == 0 for k in range(8))
        left = left[differ == 0]
    return np.minimum(out, most)


def _repeats(pieces: list):
    """Spans of the windows of ``pieces`` that also start earlier in one of them."""
    ids, starts = np.array([p.id for p in pieces], np.int64), np.array([p.start for p in pieces], np.int64)
    text = np.frombuffer(b"".join(p.data for p in pieces), np.uint8)
    sizes = np.array([len(p.data) for p in pieces])
    ends = np.cumsum(sizes)
    begin = ends - sizes
    order = suffix_array(text)
    piece = np.searchsorted(ends, order, "right")
    whole = order + LENGTH <= ends[piece]
    order, piece = order[whole], piece[whole]
    new = np.append(True, common_prefixes(text, order) < LENGTH)
    start = starts[piece] + order - begin[piece]
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort([start, ids[piece]])] = np.arange(len(order))
    least = np.minimum.reduceat(rank, np.flatnonzero(new))
    again = rank > least[np.cumsum(new) - 1]
    return _merged(ids[piece][again], start[again], start[again] + LENGTH)


# -- pieces


class Piece(NamedTuple):
    """Windows in a row, with their bytes; ``ahead``: where in the first one the anchor stands."""

    cut: int
    key: int
    id: int
    start: int
    ahead: int
    data: bytes


def _cut_pieces(piece: Piece, cut: int):
    """Windows are equal only if the anchor stands at the same place in them: groups of ``cut`` such places, each
    dealt by the bytes that all of its windows hold."""
    low, n = 0, len(piece.data) - LENGTH + 1
    while low < n:
        group = (piece.ahead - low) // cut
        front = piece.ahead - group * cut
        high = min(front + 1, n)
        shared = piece.data[front : front - cut + 1 + LENGTH]
        key = int.from_bytes(hashlib.blake2b(shared, digest_size=8, salt=bytes([group])).digest(), "little", signed=True)
        yield Piece(cut, key, piece.id, piece.start + low, piece.ahead - low, piece.data[low : high - 1 + LENGTH])
        low = high


def _distinct(pieces):
    """The first of equal pieces, and the spans (id, start, end) of the others."""
    first, spans = {}, []
    for piece in pieces:
        # cut alike and with the same key and bytes, the anchor's place is the same
        like = piece.cut, piece.key, piece.data
        other = first.setdefault(like, piece)
        if other is not piece:
            if (piece.id, piece.start) < (other.id, other.start):
                first[like], piece = piece, other
            spans.append((piece.id, piece.start, piece.start + len(piece.data)))
    return list(first.values()), spans


_PIECE = pa.schema([("cut", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("ahead", pa.int32()), ("data", pa.binary())])
#: Pieces have no end; spans have one, no bytes, and their id as key.
_FOUND = pa.schema([*_PIECE, ("end", pa.int64())])
_FOUND_SQL = "cut int, key long, id long, start long, ahead int, data binary, end long"


def _pieces_batch(pieces, spans) -> pa.RecordBatch:
    rows = [(*p, None) for p in pieces] + [(-1, doc, doc, start, None, None, end) for doc, start, end in spans]
    columns = zip(*rows) if rows else [()] * len(_FOUND)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)


def _spans_batch(doc, start, end) -> pa.RecordBatch:
    none = {f.name: pa.nulls(len(doc), f.type) for f in _FOUND}
    found = {**none, "key": pa.array(doc, pa.int64()), "id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64())}
    return pa.RecordBatch.from_arrays([found[f.name] for f in _FOUND], schema=_FOUND)


def _pieces(batches, bounds: Bounds):
    """The wanted runs with their bytes, cut if their anchor has too many."""
    for rows, data, offsets in steps(batches):
        whole = data.tobytes()
        uncut, cut = [], []
        for i, (doc, wanted) in enumerate(zip(rows.column("id").to_pylist(), rows.column("wanted").to_pylist())):
            for run in wanted:
                start, n, ahead = run["place"] >> 16, run["place"] >> 8 & 255, run["place"] & 255
                low = int(offsets[i]) + start
                piece = Piece(0, run["anchor"], doc, start, ahead, whole[low : low + n - 1 + LENGTH])
                size = bounds.cut(run["crowd"])
                if size:
                    cut.extend(_cut_pieces(piece, size))
                else:
                    uncut.append(piece)
        cut, spans = _distinct(cut)
        yield _pieces_batch(uncut + cut, spans)


def _array_spans(batches, bounds: Bounds):
    """Pieces come in the order of cut, key, id and start; those of one key go into the same array. A key with too
    many gives none of its spans: its pieces are handed back, cut again. Pieces of one window with the same key are
    equal, so the first stands for all before. Spans are handed on."""
    pieces, size = [], 0
    own, own_size, last, crowded = [], 0, None, False

    def again():
        return _pieces_batch(*_distinct(part for p in own for part in _cut_pieces(p, CUTS[CUTS.index(p.cut) + 1])))

    for batch in batches:
        is_span = batch.column("end").is_valid()
        yield batch.filter(is_span)
        batch = batch.filter(pc.invert(is_span))
        for piece in map(Piece._make, zip(*(batch.column(f.name).to_pylist() for f in _PIECE))):
            if last != (piece.cut, piece.key):
                if crowded:
                    yield again()
                else:
                    pieces += own
                    size += own_size
                own, own_size, last, crowded = [], 0, (piece.cut, piece.key), False
                if size >= bounds.array_bytes:
                    yield _spans_batch(*_repeats(pieces))
                    pieces, size = [], 0
            own.append(piece)
            own_size += len(piece.data)
            if own_size >= bounds.key_bytes and len(own) > 1:
                if piece.cut == CUTS[-1]:
                    yield _spans_batch(*_repeats(own))
                    own = own[:1]
                else:
                    yield again()
                    own, crowded = [], True
                own_size = sum(len(p.data) for p in own)
    if crowded:
        yield again()
    else:
        pieces += own
    if pieces:
        yield _spans_batch(*_repeats(pieces))


# -- the whole


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``id, text``, and ``id, doc_id`` if these differ: where a doc_id repeats or is null, the id is the row's
    number in the order of doc_id (nulls last) and text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    if rows.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        return rows.where("id is not null"), None
    by = [F.asc_nulls_last("id"), F.asc_nulls_first("text")]
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *by).withColumn("part", F.spark_partition_id())
    ordered = stored(ordered.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*by))), "ordered")
    before, total = {}, 0
    for part, count in sorted((r["part"], r["count"]) for r in ordered.groupBy("part").count().collect()):
        before[part], total = total, total + count
    offset = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("part")]
    ordered = ordered.select((offset + F.col("nth")).cast("long").alias("number"), F.col("id").alias("doc_id"), "text").withColumnRenamed("number", "id")
    return ordered.select("id", "text").where("id is not null"), ordered.select("id", "doc_id")


def _hot_anchors(docs: DataFrame, bounds: Bounds) -> DataFrame:
    """``anchor, crowd``: anchors that have very many runs in the documents looked at, and an estimate for all.

    An anchor here has one in 65,536 of the runs looked at, so there are at most as many. It is only
    dealt otherwise: no row depends on what is found here.
    """
    looked = docs.where(F.pmod(F.xxhash64("id", F.lit("look")), F.lit(LOOK)) == 0).select("id", "text").mapInArrow(_all_runs, _RUN_SQL)
    counts = stored(looked.where("same is not null").groupBy("anchor").agg(F.count("*").alias("n")), "anchor_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") > max(bounds.hot, total >> 16)).select("anchor", (F.col("n") * LOOK).alias("hot"))


def _settled(pieces: DataFrame, bounds: Bounds) -> DataFrame:
    """Spans of the pieces' windows; the pieces of too large keys are cut and dealt again, for each of CUTS at most."""
    parts, spans = shuffle_partitions(pieces.sparkSession), []
    for _ in CUTS:
        pieces = pieces.repartition(parts, "cut", "key").sortWithinPartitions("cut", "key", "id", "start")
        found = stored(pieces.mapInArrow(lambda batches: _array_spans(batches, bounds), _FOUND_SQL), "piece_spans")
        spans.append(found.where("end is not null").select("id", "start", "end"))
        pieces = found.where("end is null")
        if pieces.isEmpty():
            break
    return reduce(DataFrame.unionByName, spans)


def repeated_spans(docs: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """``id, start, end`` of bytes that a window covers which also starts earlier; spans may overlap.

    ``docs`` has one row per ``id`` (``id, text``), none null.
    """
    parts = shuffle_partitions(docs.sparkSession)
    runs = docs.select("id", "text").mapInArrow(_all_runs, _RUN_SQL)
    is_span = F.col("same").isNull()
    runs = runs.select(F.when(is_span, F.xxhash64("id")).otherwise(F.col("anchor")).alias("anchor"), "same", "id",
                       F.when(is_span, F.col("anchor")).alias("end"), "place")
    # the runs of a hot anchor are salted by their bytes, so equal ones still meet
    runs = runs.join(F.broadcast(_hot_anchors(docs, bounds)), "anchor", "left")
    runs = runs.withColumn("salt", F.when(F.col("hot").isNull() | F.col("same").isNull(), 0).otherwise(F.pmod("same", F.lit(parts))).cast("int"))
    equal, by_anchor = Window.partitionBy("anchor", "salt", "same"), Window.partitionBy("anchor", "salt")
    runs = runs.repartition(parts, "anchor", "salt")
    runs = runs.withColumn("first", F.min(F.struct("id", "place")).over(equal))
    runs = runs.withColumns({"kinds": (F.min("same").over(by_anchor) != F.max("same").over(by_anchor)) | F.col("hot").isNotNull(),
                             "crowd": F.coalesce("hot", F.count("same").over(by_anchor))})
    again = F.col("first") != F.struct("id", "place")
    found = runs.select("anchor", "id", "place", "end", "crowd", F.col("same").isNull().alias("is_span"), again.alias("again"), "kinds")
    found = stored(found.where("is_span or again or kinds"), "runs")
    spans = found.where("is_span").select("id", F.col("place").alias("start"), "end")
    start = F.shiftright("place", 16)
    spans = spans.unionByName(found.where("not is_span and again").select("id", start.alias("start"), (start + F.shiftright("place", 8) % 256 - 1 + LENGTH).alias("end")))
    wanted = found.where("not is_span and not again and kinds").groupBy("id").agg(F.collect_list(F.struct("anchor", "place", "crowd")).alias("wanted"))
    pieces = docs.join(wanted, "id").select("id", "text", "wanted").mapInArrow(lambda batches: _pieces(batches, bounds), _FOUND_SQL)
    return spans.unionByName(_settled(pieces, bounds))


def _cut(batches, with_kept: bool):
    for rows, data, offsets in steps(batches):
        size = np.diff(offsets)
        removed, n_spans, digest, kept_bytes = [], [], [], []
        for i, spans in enumerate(rows.column("spans").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            keep = np.ones(len(text), bool)
            spans = spans or []
            _, start, end = _merged(np.zeros(len(spans), np.int64), *(np.array([s[x] for s in spans], np.int64) for x in ("start", "end")))
            for low, high in zip(start.tolist(), end.tolist()):
                keep[low:high] = False
            kept = text[keep].tobytes()
            removed.append(len(text) - len(kept))
            n_spans.append(len(start))
            digest.append(hashlib.sha256(kept).hexdigest())
            kept_bytes.append(kept if with_kept else None)
        columns = [rows.column("id"), pa.array(size), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_bytes, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame, with_kept: bool = False, bounds: Bounds = Bounds()) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs`` (``doc_id, text``); with
    ``with_kept`` also ``kept``, the bytes that stay.

    Removes each byte of the texts' UTF-8 that lies in a LENGTH-byte string which also starts earlier: in a
    document with a smaller doc_id, or earlier in the same. Spans are maximal runs of removed bytes. A null or
    empty text is empty. Rows that repeat a doc_id are documents of their own, the one whose text sorts first
    is the earlier; rows without doc_id come after all others. Other columns are ignored, an empty table gives
    an empty result.
    """
    texts, names = _numbered(docs)
    # texts meet their wanted runs and later their spans in two joins on id, which read one shuffle of them
    spans = repeated_spans(texts, bounds).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = texts.join(spans, "id", "left").select("id", "text", "spans").mapInArrow(
        lambda batches: _cut(batches, with_kept), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumnRenamed("id", "doc_id") if names is None else out.join(names, "id").select("doc_id", *out.columns[1:])
    return out if with_kept else out.drop("kept")
