"""Text quality by the perplexity of an interpolated modified Kneser-Ney n-gram model.

The model is trained on trusted text. Its tokens are bytes, each after up to BYTES - 1 others. Spark counts the
n-grams of all texts, and how often each occurs in those that train; counts of an order are joined with those of
the next lower one by n-gram, until each n-gram of the corpus has its probability. The most frequent ones are sent
to every executor; for the others, a block of texts asks once each. Below one byte stands a smaller model of the
same kind, over characters in 32 classes (letters a-z, white space, capitals, digits, letters beyond ASCII,
sentence marks, other signs): a table of 32**4 probabilities, which knows the shape of what was never read.

A document is judged by its mean and by its worst word, so that a few bad words in good prose count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from realpay.llm import ctw
from realpay.llm.tables import stored, without
from realpay.llm.textbytes import NOT_SPACE, steps

ORDER = 4
CLASSES = 32
SPACE, CAPITAL, DIGIT, BEYOND, MARK, SIGN, DROPPED = 26, 27, 28, 29, 30, 31, 255
#: Trusted documents that the model is trained on, at most: those with the least hashes of their ids.
TRUSTED = 20_000
#: Quantile of the trusted documents' scores, by language, up to which a document passes.
QUANTILE = 0.995
#: Documents below which a language's quantile is the maximum of its scores.
FEW = 200
#: Bits that a text may need beyond its language's threshold, however short it is: without them, 12 of the 3,027 clean
#: documents of sf0.1 are lost that have under 40 characters, with them 4 more of the 953 others stay.
SLACK = 16
#: Bytes of an n-gram of the large model.
BYTES = 5
#: Its n-grams that are sent to every executor, at most: 16 bytes each, 4 MB. The others are joined.
SENT = 1 << 18
#: Share of the small model's probability that goes to the first bytes of characters.
FIRST = 0.75

_CLASS = np.full(256, SIGN, dtype=np.uint8)
_CLASS[np.arange(97, 123)] = np.arange(26)
_CLASS[np.arange(65, 91)] = CAPITAL
_CLASS[np.arange(48, 58)] = DIGIT
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = MARK
_CLASS[0x80:0xC0] = DROPPED  # the bytes of a character after its first
_CLASS[0xC0:] = BEYOND


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the n-gram that ends at each character, and the first character of each row.

    The first characters of a row follow white space.
    """
    code = _CLASS[data]
    kept = np.flatnonzero(code != DROPPED)
    first = np.searchsorted(kept, offsets)
    code = code[kept].astype(np.int32)
    behind = np.arange(len(code)) - np.repeat(first[:-1], np.diff(first))
    out = code.copy()
    for back in range(1, ORDER):
        before = np.full(len(code), SPACE, np.int32)
        before[back:] = code[:-back] if back < len(code) else 0
        before[behind < back] = SPACE
        out += before << 5 * back
    return out, first


def _counts(batches):
    total = np.zeros(CLASSES**ORDER, np.int64)
    for _, data, offsets in steps(batches):
        total += np.bincount(grams(data, offsets)[0], minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])


def _discounts(counts: DataFrame) -> list[float]:
    """What counts of 1, 2 and more are lessened by."""
    n = counts.where("n between 1 and 4").groupBy("n").count().collect()
    n = {k: dict(n).get(k, 0) for k in range(1, 5)}
    y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.0), k) if n[k] and n[k + 1] else 0.5 * k for k in (1, 2, 3)]


def _discounted(counts: DataFrame, order: int, below: DataFrame) -> DataFrame:
    """``gram, p`` for all n-grams of ``order``: counts less their discount, plus the context's weight times ``below``."""
    d = _discounts(counts)
    off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    seen = counts.select("gram", "n", off.alias("off"), (F.col("gram") / CLASSES).cast("long").alias("context"))
    contexts = seen.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("left"))
    all_grams = counts.sparkSession.range(CLASSES**order).withColumnRenamed("id", "gram")
    rows = all_grams.join(seen.select("gram", "n", "off"), "gram", "left").withColumn("context", (F.col("gram") / CLASSES).cast("long"))
    rows = rows.join(contexts, "context", "left").withColumn("shorter", F.col("gram") % CLASSES ** (order - 1))
    rows = rows.join(below.select(F.col("gram").alias("shorter"), F.col("p").alias("low")), "shorter")
    high = F.coalesce((F.col("n") - F.col("off")) / F.col("total"), F.lit(0.0))
    return rows.select("gram", (high + F.coalesce(F.col("left") / F.col("total"), F.lit(1.0)) * F.col("low")).alias("p"))


def train(texts: DataFrame) -> np.ndarray:
    """log2 of the probability of the last character of every n-gram, given those before it.

    Without any text all characters are equally likely.
    """
    spark = texts.sparkSession
    counts = {ORDER: stored(texts.select("text").mapInArrow(_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "counts")}
    for order in range(ORDER - 1, 0, -1):  # below the top, the number of different characters that come before
        counts[order] = stored(counts[order + 1].groupBy((F.col("gram") % CLASSES**order).alias("gram")).agg(F.count("*").alias("n")), f"counts_{order}")
    model = spark.range(1).select(F.col("id").alias("gram"), F.lit(1.0 / CLASSES).alias("p"))
    for order in range(1, ORDER):
        model = stored(_discounted(counts[order], order, model), f"model_{order}")
    model = _discounted(counts[ORDER], ORDER, model)
    rows = model.select("gram", F.log2("p").cast("float").alias("bits")).toArrow()  # as many rows for any corpus: CLASSES**ORDER
    out = np.zeros(CLASSES**ORDER, np.float32)
    out[rows["gram"].to_numpy()] = rows["bits"].to_numpy()
    return out


# -- the large model


def codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte and the BYTES - 1 before it as a number, the byte lowest. Spaces stand before a row."""
    behind = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = data.astype(np.int64)
    for back in range(1, BYTES):
        before = np.full(len(data), 0x20, np.int64)
        before[back:] = data[: max(len(data) - back, 0)]
        before[behind < back] = 0x20
        out |= before << 8 * back
    return out


_MEMBERS = np.bincount(_CLASS[_CLASS != DROPPED], minlength=CLASSES)


def _lowest(code: np.ndarray, small: np.ndarray) -> np.ndarray:
    """How probable the last byte of each code is by the classes of those before it."""
    last = _CLASS[code & 255]
    gram = np.where(last == DROPPED, 0, last).astype(np.int64) + sum(SPACE << 5 * k for k in range(1, ORDER))
    known = np.zeros(len(code), np.int64)
    for back in range(1, BYTES):
        before = _CLASS[code >> 8 * back & 255]
        use = (before != DROPPED) & (known < ORDER - 1)
        gram += np.where(use, (before.astype(np.int64) - SPACE) << 5 * (known + 1), 0)
        known += use
    return np.where(last == DROPPED, (1 - FIRST) / 64, FIRST * 2.0 ** small[gram] / _MEMBERS[np.minimum(last, CLASSES - 1)])


def _count_codes(batches):
    parts, held = [], 0
    for rows, data, offsets in steps(batches, limit=1 << 20):
        out = ~rows.column("trains").to_numpy(zero_copy_only=False)
        parts.append(np.unique(codes(data, offsets) << 1 | np.repeat(out, np.diff(offsets)), return_counts=True))
        held += len(parts[-1][0])
        if held > ctw.COUNTED:
            parts = ctw._added_up(parts)
            held = len(parts[0][0])
            if held > ctw.COUNTED // 2:
                yield ctw._counted(parts)
                parts, held = [], 0
    if parts:
        yield ctw._counted(parts)


def probabilities(rows: DataFrame) -> DataFrame:
    """``code, total, bits`` of every n-gram in ``rows`` (``text, trains``): how often it occurs, and -log2 of the
    probability of its last byte after the others, by the texts that train."""
    small = rows.sparkSession.sparkContext.broadcast(train(rows.where("trains").select("text")))
    counts = rows.mapInArrow(_count_codes, "code long, n long, total long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    orders = {BYTES: stored(counts, "codes")}
    for order in range(BYTES - 1, 0, -1):  # below the top, the number of different bytes that come before
        shorter = F.col("code").bitwiseAND((1 << 8 * order) - 1)
        orders[order] = stored(orders[order + 1].groupBy(shorter.alias("code")).agg(F.count_if(F.col("n") > 0).alias("n")), f"codes_{order}")
    below = None
    for order, own in sorted(orders.items()):
        d = _discounts(own)
        off = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        own = own.withColumns({"off": off, "context": F.shiftright("code", 8)})
        contexts = own.groupBy("context").agg(F.sum("n").alias("of"), F.sum("off").alias("off"))
        weight = F.when(F.col("of") > 0, F.col("off") / F.col("of")).otherwise(1.0)
        own = own.join(contexts.select("context", "of", weight.alias("weight")), "context")
        high, low, left = F.when(F.col("n") > 0, (F.col("n") - F.col("off")) / F.col("of")).otherwise(0.0), F.lit(0.0), F.lit(1.0)
        if below is not None:
            own = own.withColumn("shorter", F.col("code").bitwiseAND((1 << 8 * (order - 1)) - 1)).join(below.toDF("shorter", "low", "left"), "shorter")
            low, left = F.col("low"), F.col("left")
        total = ["total"] if order == BYTES else []
        # what the bytes say, and the weight that is left for the small model
        below = own.select("code", *total, (high + F.col("weight") * low).alias("own"), (F.col("weight") * left).alias("left"))
        if order < BYTES:  # the last and largest is stored with its bits
            below = stored(below, f"byte_model_{order}")

    def bits(batches):
        for batch in batches:
            code, total, own, left = (batch.column(c).to_numpy() for c in ("code", "total", "own", "left"))
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total), pa.array(-np.log2(own + left * _lowest(code, small.value)))], names=["code", "total", "bits"])

    return stored(below.mapInArrow(bits, "code long, total long, bits double"), "code_bits")


# -- scoring


_BLOCK = pa.schema([("block", pa.int64()), ("key", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("lang", pa.list_(pa.string())), ("size", pa.list_(pa.int64())),
                    ("bits", pa.list_(pa.float64())), ("worst", pa.list_(pa.float64())), ("n_words", pa.list_(pa.int64())), ("word_bits", pa.list_(pa.float64())),
                    ("word_bytes", pa.binary()), ("n_codes", pa.binary()), ("numbers", pa.binary()), ("code", pa.list_(pa.int64()))])
_BLOCK_SQL = ("block long, key array<long>, doc_id array<long>, lang array<string>, size array<long>, bits array<double>, worst array<double>, "
              "n_words array<long>, word_bits array<double>, word_bytes binary, n_codes binary, numbers binary, code array<long>")


def _worst(row: np.ndarray, bits: np.ndarray, n_rows: int) -> np.ndarray:
    out = np.zeros(n_rows)
    np.maximum.at(out, row, bits)
    return out


def _part(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, sent: ctw.Common) -> list:
    """What the sent n-grams say about each row; its words that hold others; and these, word by word.

    A word ends where the next one begins; white space after it counts as one byte.
    """
    unique, which = np.unique(codes(data, offsets), return_inverse=True)
    known, here = sent.look_up(unique)
    known, lacks = known[which], ~here[which]
    n, of_row = len(rows), np.repeat(np.arange(len(rows)), np.diff(offsets))
    inside = NOT_SPACE[data]
    new = inside & ~np.append(False, inside[:-1])[: len(inside)]
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    first = np.flatnonzero(new)
    if len(first):
        word_bits, word_bytes, n_codes = np.add.reduceat(known, first), np.add.reduceat(inside.astype(np.int64), first) + 1, np.add.reduceat(lacks.astype(np.int64), first)
    else:
        word_bits, word_bytes, n_codes = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, whole = of_row[first], n_codes == 0
    worst = _worst(row[whole], (word_bits / word_bytes)[whole], n)
    size = np.bincount(of_row, _CLASS[data] != DROPPED, n).astype(np.int64)
    own = [rows.column(c).to_pylist() for c in ("key", "doc_id", "lang")]
    return [*own, size, np.bincount(of_row, known, n), worst, np.bincount(row[~whole], minlength=n), word_bits[~whole], word_bytes[~whole], n_codes[~whole], unique[which[lacks]]]


def _block(number: int, parts: list) -> pa.RecordBatch:
    joined = [sum((p[i] for p in parts), []) if i < 3 else np.concatenate([p[i] for p in parts]) for i in range(11)]
    code, numbers = np.unique(joined.pop(), return_inverse=True)
    row = [number, *joined[:8], ctw._packed(joined[8]), ctw._packed(joined[9]), ctw._packed(numbers), code]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)


def _blocks(batches, sent: ctw.Common):
    number, parts, held = TaskContext.get().partitionId() << 32, [], 0
    for rows, data, offsets in steps(batches):
        parts.append(_part(rows, data, offsets, sent))
        held += len(data)
        if held >= ctw.BLOCK_BYTES:
            yield _block(number, parts)
            number, parts, held = number + 1, [], 0
    if parts:
        yield _block(number, parts)


def _finish(batches):
    for batch in batches:
        for row in range(len(batch)):
            get = lambda name: batch.column(name)[row].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            raw = lambda name: ctw._unpacked(batch.column(name)[row].as_py())  # noqa: B023, E731
            total, worst, n = get("bits").copy(), get("worst").copy(), len(get("size"))
            if batch.column("place")[row].is_valid:
                bits = np.empty(len(get("place")))
                bits[get("place")] = get("found")
                bits, n_codes = bits[raw("numbers")], raw("n_codes")
                added = np.add.reduceat(bits, np.cumsum(n_codes) - n_codes)
                of_row = np.repeat(np.arange(n), get("n_words"))
                total += np.bincount(of_row, added, n)
                worst = np.maximum(worst, _worst(of_row, (get("word_bits") + added) / raw("word_bytes"), n))
            columns = [*(batch.column(c)[row].values for c in ("key", "doc_id", "lang", "size")), pa.array(total / np.maximum(get("size"), 1)), pa.array(worst)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "lang", "size", "bits", "worst"])


def _scored(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``key, doc_id, lang, size, bits, worst`` of each of ``rows`` (``key, doc_id, lang, text``): characters, bits
    per character, and bits per byte of the worst word."""
    least = ctw._least_count(model, SENT)
    found = model.where(F.col("total") >= least).select("code", "bits").toArrow().sort_by("code")
    sent = rows.sparkSession.sparkContext.broadcast(ctw.Common(found["code"].to_numpy(), found["bits"].to_numpy()))
    blocks = stored(rows.mapInArrow(lambda batches: _blocks(batches, sent.value), _BLOCK_SQL), "blocks")
    # the hint: Spark would judge the exploded codes by the size of the lists' files
    asked = blocks.select("block", F.posexplode("code").alias("place", "code")).join(model.where(F.col("total") < least).select("code", "bits").hint("merge"), "code")
    found = asked.groupBy("block").agg(F.collect_list(F.struct("place", "bits")).alias("x")).select("block", F.col("x.place").alias("place"), F.col("x.bits").alias("found"))
    out = blocks.drop("code").join(found, "block", "left")
    return out.mapInArrow(_finish, "key long, doc_id long, lang string, size long, bits double, worst double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id, trains``: documents that every label of theirs calls good and none toxic.

    Of the half with even hashes the TRUSTED with the least hashes train the model; all others set the thresholds.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    trusted = stored(good.where("quality = 1 and toxic = 0").select("doc_id"), "trusted")
    sample = trusted.where(F.xxhash64("doc_id") % 2 == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED)
    sample = F.broadcast(stored(sample, "sample").withColumn("trains", F.lit(True)))
    return trusted.join(sample, "doc_id", "left").select("doc_id", F.coalesce("trains", F.lit(False)).alias("trains"))


def thresholds(scores: DataFrame, trusted: DataFrame) -> DataFrame:
    """``lang, threshold, worst_threshold`` from the trusted documents that did not train the model: quantiles of
    ``bits`` and ``worst`` over all of them, on scores rounded up to 0.01.

    With fewer than FEW documents of a language its quantile is their maximum; what they lack of FEW is made up for by
    the quantile of all languages, where that is higher.
    """
    own = scores.where("size > 0").join(trusted.where("not trains"), "doc_id", "left_semi")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.ceil(F.col(c) * 100).alias("bin")) for c in ("bits", "worst"))))
    bins = stored(own.select("lang", each.alias("x")).groupBy("lang", "x.of", "x.bin").agg(F.count("*").alias("n")), "score_bins")
    by_lang = _quantiles(bins, "lang", "of")
    pooled = _quantiles(bins.groupBy("of", "bin").agg(F.sum("n").alias("n")), "of").select("of", F.col("at").alias("pooled"))
    lacks = F.greatest(F.lit(0), FEW - F.col("total")) / FEW
    at = F.ceil((F.col("at") + lacks * F.greatest(F.lit(0.0), F.col("pooled") - F.col("at"))) * 100) / 100
    limit = lambda c: F.max(F.when(F.col("of") == c, at))
    return by_lang.join(F.broadcast(pooled), "of").groupBy("lang").agg(limit("bits").alias("threshold"), limit("worst").alias("worst_threshold"))


def _quantiles(bins: DataFrame, *keys: str) -> DataFrame:
    """``keys, total, at``: rows and QUANTILE of each group of ``bins`` (``keys, bin, n``)."""
    within = f"over (partition by {', '.join(keys)}"
    ranked = bins.select(*keys, "bin", F.expr(f"sum(n) {within} order by bin)").alias("upto"), F.expr(f"sum(n) {within})").alias("total"))
    return ranked.where(F.col("upto") >= QUANTILE * F.col("total")).groupBy(*keys).agg(F.max("total").alias("total"), (F.min("bin") / 100).alias("at"))


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The scores of all rows of ``docs``, each with its :func:`_key`, the thresholds and ``keep``."""
    trusted = stored(trusted_ids(labels), "split")
    sample = F.broadcast(trusted.where("trains"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = probabilities(rows.join(sample, "doc_id", "left").select("text", F.coalesce("trains", F.lit(False)).alias("trains")))
    rows = docs.select(_key(docs).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(docs["lang"], F.lit("")).alias("lang"), "text")
    scores = stored(_scored(rows, model), "scores")
    limits = stored(thresholds(scores, trusted), "thresholds")
    highest = limits.agg(F.max("threshold"), F.max("worst_threshold")).first()
    out = scores.join(limits, "lang", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(x).cast("double")) for c, x in zip(("threshold", "worst_threshold"), highest)})
    passes = F.lit(True) if highest[0] is None else (F.col("bits") * F.col("size") <= F.col("threshold") * F.col("size") + SLACK) & (F.col("worst") <= F.col("worst_threshold"))
    return out.withColumn("keep", (F.col("size") > 0) & passes)


def _key(docs: DataFrame):
    """Rows with the same key have the same text and language, and are judged alike."""
    return F.xxhash64(docs["doc_id"], docs["text"], docs["lang"])


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, n_characters, bits_per_character, perplexity, threshold, keep, worst_word, worst_threshold``
    for each row of ``docs``.

    ``docs`` has ``doc_id, text, lang``, ``labels`` has ``doc_id, quality, toxic``. A document is kept if it
    needs no more bits than its language's threshold allows, and SLACK besides, and its worst word no more bits per byte
    than the threshold of these. A language without trusted documents gets the highest thresholds of all; if
    there are none at all, every text is kept. A null or empty text has zero characters, null scores and is not
    kept. Repeated rows are scored each, a null lang is the language ''. Other columns are ignored.
    """
    out = _judged(docs, labels)
    bits, worst = (F.when(F.col("size") > 0, F.col(c)) for c in ("bits", "worst"))
    return out.select("doc_id", "lang", F.col("size").alias("n_characters"), bits.alias("bits_per_character"),
                      F.pow(F.lit(2.0), bits).alias("perplexity"), "threshold", "keep", worst.alias("worst_word"), "worst_threshold")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`judged` keeps, as they are."""
    # beside its hash a row is told by its id, so a row whose hash equals that of a rejected one stays
    rejected = _judged(docs, labels).where("not keep").select("key", F.coalesce("doc_id", F.lit(0)).alias("doc_id"))
    return without(docs, {"key": _key(docs), "doc_id": F.coalesce(docs["doc_id"], F.lit(0))}, rejected)
