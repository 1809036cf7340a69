"""Benchmark passages in documents, by winnowing.

Winnowing (Schleimer, Wilkerson, Aiken, 2003) keeps, of every window of consecutive k-gram hashes, the least.
Two texts that share ``window`` words share all k-grams inside, so they keep the same fingerprint there:
no shared span of that length escapes. Fingerprints with their place and the words around them are joined by
hash; a pair is extended to the left and to the right word by word, as far as a window with that fingerprint can
reach. An extended span of ``window`` words or more is a hit.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from realpay.llm.tables import stored, without
from realpay.llm.textbytes import ALNUM, LOWER, joined_words, prefix_sums, range_hashes, sequence_hashes, sliding_min, steps, words as word_bounds

WINDOW = 10
#: Words of a k-gram; a window of 10 words then has 6 k-grams, of which winnowing keeps the least.
GRAM = 5
#: Bits of the filter that a document's fingerprints pass before the join: 16 per fingerprint of the items, between
#: these bounds (1 MB and 16 MB). A fuller filter lets more rows through to the join, which settles them.
FILTER_BITS = 1 << 23, 1 << 27
#: Different surroundings of a fingerprint in the items beyond which it isn't paired but joined by whole windows.
PAIRS = 32


def _prints(word_hashes: np.ndarray, first: np.ndarray, n: int):
    """The places of the winnowed k-grams of all windows of ``n`` words inside one row, and their hashes.

    In a window with ties for the least hash all of them are kept.
    """
    gram = min(GRAM, n)
    grams, width = sequence_hashes(word_hashes, gram), n - gram + 1
    least = sliding_min(grams, width)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(len(word_hashes))
    least = np.where(room[: len(least)] >= n, least, np.uint64(0))
    none = np.zeros(width - 1, np.uint64)
    greatest = ~sliding_min(~np.concatenate([none, least, none]), width)
    at = np.flatnonzero(grams == greatest) if len(least) else np.zeros(0, np.int64)
    return at, grams[at]


def _rows(batches, id_column, lengths, wanted):
    """Per row: the id, the number of words, and its fingerprints; only the ``wanted`` ones, if given.

    ``lengths``: for each window size, if it applies to all rows (documents) or, as a function of the rows'
    word counts, to some (items). A fingerprint has its place ``at``, and the ``words`` that windows with it can
    reach, of which ``ahead`` stand before it.
    """
    for rows, data, offsets in steps(batches):
        starts, ends, first = word_bounds(data := LOWER[data], offsets, ALNUM)
        data, starts, ends = joined_words(data, starts, ends)
        hashes = range_hashes(prefix_sums(data), starts, ends)
        text, per_row = data.tobytes(), np.diff(first)
        at, size, prints = [], [], []
        for n, of in lengths:
            a, p = _prints(hashes, first, n)
            ok = of(np.repeat(per_row, per_row)[a])
            if wanted is not None:
                ok &= wanted(p)
            at.append(a[ok])
            size.append(np.full(ok.sum(), n))
            prints.append(p[ok])
        at, size, prints = map(np.concatenate, (at, size, prints))
        order = np.argsort(at, kind="stable")
        at, size, prints = at[order], size[order], prints[order]
        cut = pa.array(np.searchsorted(at, first).astype(np.int32))
        row = np.searchsorted(first, at, "right") - 1
        low = np.maximum(first[row], at - size + np.minimum(size, GRAM))
        high = np.minimum(first[row + 1], at + size)
        around = pa.array([text[s:e] for s, e in zip(starts[low].tolist(), ends[high - 1].tolist())], pa.binary()).cast(pa.string())
        parts = [pa.array(at - first[row]), pa.array(size), pa.array(prints.view(np.int64)), pa.array(at - low), around]
        found = pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays(parts, ["at", "size", "fp", "ahead", "words"]))
        yield pa.RecordBatch.from_arrays([rows.column(id_column).cast(pa.int64()), pa.array(per_row.astype(np.int64)), found], names=["id", "n_words", "found"])


_SCHEMA = "id long, n_words long, found array<struct<at: long, size: long, fp: long, ahead: long, words: string>>"


def _filter_words(prints: DataFrame) -> np.ndarray:
    """A bit for every fingerprint modulo the number of bits; a 64th of that in rows comes to the driver."""
    least, most = FILTER_BITS
    bits = min(most, max(least, 1 << (16 * prints.count()).bit_length()))
    bit = F.pmod("fp", F.lit(bits))
    rows = prints.select((bit / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(fp, {bits}) % 64 as int))").alias("bit"))
    rows = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words_ = np.zeros(bits // 64, np.uint64)
    words_[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return words_


def item_prints(items: DataFrame, window: int = WINDOW, id_column: str = "item_id") -> DataFrame:
    """``id, size, fp, ahead, words``: the fingerprints of the items and the words around, each at most once per item.

    An item of fewer words than ``window`` is one window of all its words; one without words, or null, has none.
    """
    lengths = [(n, lambda w, n=n: w == n) for n in range(1, window)] + [(window, lambda w: w >= window)]
    rows = items.select(id_column, "text").mapInArrow(lambda batches: _rows(batches, id_column, lengths, None), _SCHEMA)
    return rows.select("id", F.explode("found").alias("w")).select("id", "w.size", "w.fp", "w.ahead", "w.words").distinct()


def _extended(pairs: DataFrame) -> DataFrame:
    """``row, begin, end, pid``: pairs of fingerprints extended word by word, those that reach ``size`` words.

    The document's side of a pair has ``row, at, ahead, words``, the item's ``other_ahead, other_words, pid``. Words to
    the right count from the first of the k-gram, so that a pair of equal hashes but different words ends at once.
    """
    pairs = pairs.withColumns({"own": F.split("words", " "), "other": F.split("other_words", " ")})
    pairs = pairs.withColumns({
        "left": F.expr("aggregate(sequence(0L, least(ahead, other_ahead)), 0L, (n, k) -> if(k > 0 and n = k - 1"
                       " and own[int(ahead - k)] = other[int(other_ahead - k)], k, n))"),
        "right": F.expr("aggregate(sequence(0L, least(size(own) - ahead, size(other) - other_ahead)), 0L, (n, k) -> if(k > 0 and n = k - 1"
                        " and own[int(ahead + k - 1)] = other[int(other_ahead + k - 1)], k, n))")})
    long_enough = (F.col("right") >= F.least("size", F.lit(GRAM))) & (F.col("left") + F.col("right") >= F.col("size"))
    return pairs.where(long_enough).select("row", (F.col("at") - F.col("left")).alias("begin"), (F.col("at") + F.col("right")).alias("end"), "pid")


def _window_texts(prints: DataFrame) -> DataFrame:
    """A row for every window around a fingerprint: ``skip`` words of ``words`` before it, ``passage``."""
    own = F.split("words", " ")
    low = F.greatest(F.lit(0), F.col("ahead") - F.col("size") + F.least("size", F.lit(GRAM)))
    each = prints.withColumn("skip", F.explode(F.sequence(low, F.least("ahead", F.size(own) - F.col("size")))))
    return each.withColumn("passage", F.array_join(F.slice(own, (F.col("skip") + 1).cast("int"), F.col("size").cast("int")), " "))


def _merged(hits: DataFrame) -> DataFrame:
    """``row, spans``: the hits of each row, put together where they overlap or touch. Linear in a row's hits."""
    order = Window.partitionBy("row").orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = hits.select("row", "begin", "end", F.when(F.col("begin") <= before, 0).otherwise(1).alias("opens"))
    numbered = opens.withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = numbered.groupBy("row", "span").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def _hits(prints: DataFrame, known: DataFrame, pairs: int) -> tuple[DataFrame, DataFrame]:
    """``row, begin, end, pid`` of the hits, and ``pid, id``: which items have what was hit.

    A fingerprint with at most ``pairs`` different surroundings in the items is paired with each. A more frequent
    one gets the window as a second key: the windows around it are joined whole.
    """
    by_print, by_words = ["size", "fp"], ["size", "fp", "ahead", "words"]
    contexts = known.select(by_words).distinct()
    crowds = contexts.groupBy(by_print).agg(F.count("*").alias("crowd"))
    contexts = stored(contexts.join(crowds, by_print).withColumn("pid", F.monotonically_increasing_id()), "contexts")
    few = contexts.where(F.col("crowd") <= pairs)
    sides = few.select("size", "fp", F.col("ahead").alias("other_ahead"), F.col("words").alias("other_words"), "pid")
    hits = _extended(prints.join(sides, by_print))
    owners = known.join(few, by_words).select("pid", "id")
    many = contexts.where(F.col("crowd") > pairs)
    if not many.isEmpty():
        key = ["size", "fp", "passage"]
        hot = many.select(by_print).distinct()
        windows = stored(_window_texts(many).select(key).distinct().withColumn("pid", -1 - F.monotonically_increasing_id()), "hot_windows")
        found = _window_texts(prints.join(hot, by_print, "left_semi")).join(windows, key)
        begin = F.col("at") - F.col("ahead") + F.col("skip")
        hits = hits.unionByName(found.select("row", begin.alias("begin"), (begin + F.col("size")).alias("end"), "pid"))
        own = _window_texts(known.join(hot, by_print, "left_semi")).select(*key, "id").distinct()
        owners = owners.unionByName(own.join(windows, key).select("pid", "id"))
    return hits.distinct(), owners.where("id is not null")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, pairs: int = PAIRS) -> DataFrame:
    """Which words of each document lie in an occurrence of a window of an item.

    Returns per row of ``docs`` (``doc_id, text``): ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated`` and ``spans``, the hit words as (begin, end) pairs, end exclusive. ``items`` has ``item_id,
    text``; an item_id that repeats is one item, and an item without id hits words but isn't listed. Null and
    empty texts have no words. Every row of ``docs`` is judged by itself and gives one row, also if its doc_id
    is null or repeats. Other columns are ignored; with an empty benchmark nothing is hit.

    A document's fingerprints leave the task that reads it only if they pass a filter made from the items'; the join
    settles the rest, so the filter only saves work. Items are listed once per class of rows that hit the same.
    """
    known = stored(item_prints(items, window), "item_prints")
    sizes = {window, *(r["size"] for r in known.select("size").distinct().collect())}
    lengths = [(n, lambda per_row: np.ones(len(per_row), bool)) for n in sizes]
    sent = docs.sparkSession.sparkContext.broadcast(_filter_words(known.select("fp").distinct()))

    def wanted(prints: np.ndarray) -> np.ndarray:
        at = (prints.view(np.int64) % (64 * len(sent.value))).astype(np.int64)
        return (sent.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    rows = docs.select("doc_id", "text").mapInArrow(
        lambda batches: _rows(batches, "doc_id", lengths, wanted), _SCHEMA)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "doc_prints")
    prints = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("w")).select("row", "w.*")
    hits, owners = _hits(prints, known, pairs)
    hits = stored(hits, "hits")
    classes = hits.groupBy("row").agg(F.array_sort(F.collect_set("pid")).alias("pids"))
    classes = classes.withColumn("class", F.sha2(F.array_join(F.col("pids").cast("array<string>"), ","), 256))
    listed = classes.groupBy("class").agg(F.first("pids").alias("pids")).select("class", F.explode("pids").alias("pid")).join(owners, "pid")
    listed = listed.select("class", "id").distinct().groupBy("class").agg(F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("ids"))
    listed = listed.select("class", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    listed = classes.select("row", "class").join(listed, "class").drop("class")
    none = F.array().cast("array<struct<begin: bigint, end: bigint>>")
    out = rows.select("row", F.col("id").alias("doc_id"), "n_words").join(_merged(hits), "row", "left").join(listed, "row", "left")
    out = out.withColumn("spans", F.coalesce("spans", none))
    n_hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.begin)")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any hit word."""
    hit = contamination(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), items, window).where("contaminated")
    return without(docs, {"doc_id": F.xxhash64(docs["doc_id"], docs["text"])}, hit.select("doc_id"))
