"""Text probabilities by context-tree weighting over bytes, and a unigram base line.

A byte is eight binary decisions; each of the 255 nodes of that decision tree has a context tree over the
bytes before (Willems, Shtarkov, Tjalkens, 1995). Every context keeps a Krichevsky-Trofimov estimate from the
zeros and ones counted there. A node's weighted probability is half its own estimate's plus half the product
of its children's, so the prediction mixes the estimates of all depths, weighted by how well each has coded
the training text.

The tree holds every context of up to DEPTH bytes of the training text, no matter how rare: it grows with the corpus
until all strings of that length have been seen, and a text's bytes further back are not used. It is dealt by the TOP nearest
bytes: each subtree below is weighted on its own, the few levels above are aggregated and joined. What is
kept of it is the score of every string of DEPTH + 1 bytes that any text holds. Texts look their strings up
in two ways with the same result: the COMMON most frequent from a table of bounded size on every executor, all
others by a join.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from realpay.llm.tables import shuffle_partitions, stored
from realpay.llm.textbytes import LOWER, NOT_SPACE, joined_words, prefix_sums, range_hashes, steps, words

DEPTH = 5
#: Contexts of so many bytes deal the tree.
TOP = 3
#: Strings that are sent to every executor, at most: 12 bytes each, 25 MB. The others are joined.
COMMON = 1 << 21
END = 0x0A  # no word holds it
#: Training: documents whose crc32(doc_id as text) modulo FOLDS is not 0.
FOLDS = 10
#: Strings that a partition counts before it hands them on.
COUNTED = 1 << 20
#: Strings whose subtrees are worked on together, about.
SUBTREES = 1 << 16
#: Bytes of text whose tokens are looked up together.
BLOCK_BYTES = 1 << 23
_END_TOKEN = np.uint64(0xE4D)
_HALF = math.log(0.5)


def held_out(doc_id):
    """A document without id trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


# -- the text as the model sees it


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """The words, lower-cased, a space after each: bytes, word starts and ends, first word and first byte of each row."""
    starts, ends, first = words(data := LOWER[data], offsets, NOT_SPACE)
    data, starts, ends = joined_words(data, starts, ends)
    return data, starts, ends, first, np.append(starts, len(data))[first]


def _codes(data: np.ndarray, row_bytes: np.ndarray):
    """For each byte of a row, and an END after its last: the byte and the DEPTH before it as a number, the
    byte lowest and the nearest next. Also the first position of each row. Before a row's first byte stand ENDs."""
    length = np.diff(row_bytes)
    base = np.cumsum(length + DEPTH + 1) - (length + DEPTH + 1)
    buffer = np.full(int((length + DEPTH + 1).sum()), END, dtype=np.uint8)
    buffer[np.arange(len(data)) + np.repeat(base + DEPTH - row_bytes[:-1], length)] = data
    at = np.arange(int((length + 1).sum())) + np.repeat(DEPTH * np.arange(1, len(length) + 1), length + 1)
    code = np.zeros(len(at), np.int64)
    for before in range(DEPTH, -1, -1):
        code = code << 8 | buffer[at - before]
    return code, np.concatenate([[0], np.cumsum(length + 1)])


# -- counting


def _added_up(parts: list) -> list:
    """One pair of arrays, keys and counts, from many."""
    keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return [(keys, np.bincount(which, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64))]


def _counted(parts: list) -> pa.RecordBatch:
    (keys, n), = _added_up(parts)
    return pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array(np.where(keys & 1, 0, n)), pa.array(n)], names=["code", "n", "total"])


def _count(batches):
    """How often each string occurs in training texts, and in all."""
    parts, held = [], 0
    for rows, data, offsets in steps(batches, limit=1 << 20):
        data, _, _, _, row_bytes = _tokens(data, offsets)
        code, first = _codes(data, row_bytes)
        out = rows.column("held_out").to_numpy(zero_copy_only=False).astype(np.int64)
        parts.append(np.unique(code << 1 | np.repeat(out, np.diff(first)), return_counts=True))
        held += len(parts[-1][0])
        if held > COUNTED:
            parts = _added_up(parts)
            held = len(parts[0][0])
            if held > COUNTED // 2:
                yield _counted(parts)
                parts, held = [], 0
    if parts:
        yield _counted(parts)


def strings(rows: DataFrame) -> DataFrame:
    """``code, n, total`` for every string of DEPTH + 1 bytes in ``rows`` (``text, held_out``): how often it
    occurs in texts that are not held out, and in all."""
    counts = rows.select("text", "held_out").mapInArrow(_count, "code long, n long, total long")
    return stored(counts.groupBy("code").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "strings")


# -- the tree


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after moving small arguments up; x > 0."""
    small = x < 10
    y = np.where(small, x + 10, x)
    shift = np.ones_like(x)
    for i in range(10):
        shift *= np.where(small, x + i, 1.0)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def _log_kt(ones: np.ndarray, both: np.ndarray) -> np.ndarray:
    """log of the probability that the estimator gives to a sequence with these counts."""
    return _log_gamma(ones + 0.5) + _log_gamma(both - ones + 0.5) - _log_gamma(both + 1.0) - 2 * math.lgamma(0.5)


def _weigh(ones: np.ndarray, both: np.ndarray, below: np.ndarray | None):
    """The estimate of a one, its share in the mixture, and the log of the weighted probability. ``below``: the
    sum of the children's logs, None at the deepest level."""
    estimate, own = (ones + 0.5) / (both + 1), _log_kt(ones, both)
    if below is None:
        return estimate, np.ones(len(own)), own
    weighted = np.logaddexp(own, below) + _HALF
    return estimate, np.exp(own + _HALF - weighted), weighted


def _above(depth: int) -> int:
    """Masks a key (context, then decision as the lowest byte) to that of its context of ``depth`` bytes."""
    return (1 << 8 * (depth + 1)) - 1


class _Level(NamedTuple):
    """The nodes of one depth: their keys, ascending; where in that level each node of the next deeper one, or
    each decision of each string, belongs; the counts, and what :func:`_weigh` makes of them."""

    keys: np.ndarray
    parents: np.ndarray
    ones: np.ndarray
    both: np.ndarray
    estimate: np.ndarray
    share: np.ndarray
    weighted: np.ndarray


def _decisions(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each string, the keys of the eight decisions of its byte below its whole context, and the outcomes."""
    bit = np.arange(8)
    byte = (code & 255)[:, None]
    return code[:, None] & ~255 | 1 << bit | byte >> 8 - bit, byte >> 7 - bit & 1


def _levels(code: np.ndarray, n: np.ndarray) -> list[_Level]:
    """The tree of these strings from depth DEPTH up to TOP."""
    keys, outcome = _decisions(code)
    ones, both, below, out = (outcome * n[:, None]).ravel(), np.repeat(n, 8), None, []
    keys = keys.ravel()
    for depth in range(DEPTH, TOP - 1, -1):
        keys, parents = np.unique(keys & _above(depth), return_inverse=True)
        ones, both = (np.bincount(parents, x, len(keys)) for x in (ones, both))
        below = None if depth == DEPTH else np.bincount(parents, out[-1].weighted, len(keys))
        out.append(_Level(keys, parents, ones, both, *_weigh(ones, both, below)))
    return out


def _whole_groups(batches):
    """Tables of about SUBTREES rows that hold all rows of each of their groups, in the order of ``group``."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= SUBTREES:
            table = pa.Table.from_batches(held)
            group = table["group"].to_numpy()
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield table.slice(0, cut)
                held, n = table.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(held)


def _strings_of(table: pa.Table) -> tuple[np.ndarray, ...]:
    code, n, total = (table[c].to_numpy() for c in ("code", "n", "total"))
    order = np.argsort(code)
    return code[order], n[order].astype(np.float64), total[order]


def _subtrees(batches):
    for table in _whole_groups(batches):
        code, n, _ = _strings_of(table)
        top = _levels(code, n)[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (top.keys, top.ones, top.both, top.weighted)], names=["key", "ones", "both", "below"])


def _weigh_rows(batches):
    for batch in batches:
        ones, both, below = (batch.column(c).to_numpy() for c in ("ones", "both", "below"))
        columns = [batch.column("key"), *(pa.array(x) for x in (ones, both, *_weigh(ones, both, below)))]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "ones", "both", "estimate", "share", "below"])


def _string_scores(batches):
    """Rows are strings, and the nodes at depth TOP with what is mixed above them."""
    for table in _whole_groups(batches):
        code, n, total = _strings_of(table.filter(table["total"].is_valid()))
        above = table.filter(table["total"].is_null()).sort_by("code")
        mixed, left = (above[c].to_numpy() for c in ("mixed", "left"))
        levels = _levels(code, n)
        for i in range(len(levels) - 1, -1, -1):  # down: the mixture of all depths
            level = levels[i]
            if i < len(levels) - 1:
                parents = levels[i + 1].parents
                mixed, left = mixed[parents], left[parents]
            mixed, left = mixed + left * level.share * level.estimate, left * (1 - level.share)
        one = np.clip(mixed, 1e-15, 1 - 1e-15)[levels[0].parents].reshape(-1, 8)
        outcome = _decisions(code)[1]
        log10 = np.log10(np.where(outcome, one, 1 - one)).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total), pa.array(log10)], names=["code", "total", "log10"])


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), "group").sortWithinPartitions("group")


def tree_scores(counts: DataFrame) -> DataFrame:
    """``code, total, log10`` of :func:`strings`: how probable the last byte of each is after the others.

    A string that no training text holds has a count of zero there and is scored all the same. Without any
    training text all bytes are equally likely.
    """
    own = counts.select(F.shiftright("code", 8).bitwiseAND((1 << 8 * TOP) - 1).alias("group"), "*")
    nodes = stored(_dealt(own).mapInArrow(_subtrees, "key long, ones double, both double, below double"), "subtrees")
    # above TOP: a node has 256 children at most, and all sums combine before the shuffle
    up, rows = [], nodes
    for depth in range(TOP - 1, -1, -1):
        sums = [F.sum(c).alias(c) for c in ("ones", "both", "below")]
        rows = rows.groupBy(F.col("key").bitwiseAND(_above(depth)).alias("key")).agg(*sums)
        rows = stored(rows.mapInArrow(_weigh_rows, "key long, ones double, both double, estimate double, share double, below double"), f"level_{depth}")
        up.append(rows)
    down = up[-1].select("key", (F.col("share") * F.col("estimate")).alias("mixed"), (1 - F.col("share")).alias("left"))
    for depth, rows in zip(range(TOP - 1), up[-2::-1]):
        rows = rows.withColumn("up", F.col("key").bitwiseAND(_above(depth))).join(down.withColumnRenamed("key", "up"), "up")
        mixed = F.col("mixed") + F.col("left") * F.col("share") * F.col("estimate")
        down = rows.select("key", mixed.alias("mixed"), (F.col("left") * (1 - F.col("share"))).alias("left"))
    nodes = nodes.select("key", F.col("key").bitwiseAND(_above(TOP - 1)).alias("up")).join(down.withColumnRenamed("key", "up"), "up")
    nodes = nodes.select(F.shiftright("key", 8).alias("group"), F.col("key").alias("code"), "mixed", "left")
    rows = _dealt(own.unionByName(nodes, allowMissingColumns=True))
    return stored(rows.mapInArrow(_string_scores, "code long, total long, log10 double"), "scored_strings")


def _least_count(scored: DataFrame, most: int) -> float:
    """A count that about ``most`` strings reach at most, from a histogram of the counts' logarithms, in eighths."""
    eighth = F.floor(8 * F.log2("total"))
    bins = sorted(scored.groupBy(eighth.alias("bin")).count().collect(), reverse=True)
    taken, least = 0, 1.0
    for b, n in bins:
        taken += n
        if taken > most:
            return 2 ** ((b + 1) / 8)
        least = 2 ** (b / 8)
    return least


class Common(NamedTuple):
    """The scores of the most frequent strings."""

    codes: np.ndarray
    log10: np.ndarray

    def look_up(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each, 0 for one that is not here, and whether it is."""
        if not len(self.codes):
            return np.zeros(len(code)), np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        here = self.codes[at] == code
        return np.where(here, self.log10[at], 0.0), here


def _common(scored: DataFrame) -> tuple[Common, DataFrame]:
    """The COMMON most frequent strings at most, and the rest."""
    least = _least_count(scored, COMMON)
    found = scored.where(F.col("total") >= least).select("code", F.col("log10").cast("float").alias("log10")).toArrow()
    code = found["code"].to_numpy()
    order = np.argsort(code)
    return Common(code[order], found["log10"].to_numpy()[order]), scored.where(F.col("total") < least).select("code", F.col("log10").cast("float").alias("log10"))


# -- scoring


def _packed(values: np.ndarray) -> bytes:
    """Small non-negative numbers: 32 bits each, byte planes apart, compressed."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


_PAIRS = [("n_pairs", pa.list_(pa.int64())), ("steps", pa.binary()), ("times", pa.binary())]
_BLOCK = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())),
                    ("n_bytes", pa.list_(pa.int64())), ("score", pa.list_(pa.float64())), ("token", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), *_PAIRS,
                    ("code", pa.list_(pa.int64())), *((f"code_{name}", kind) for name, kind in _PAIRS)])
_BLOCK_SQL = ("block long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, n_bytes array<long>, score array<double>, "
              "token array<long>, n array<long>, n_pairs array<long>, steps binary, times binary, "
              "code array<long>, code_n_pairs array<long>, code_steps binary, code_times binary")


def _pairs(values: np.ndarray, doc: np.ndarray, n_docs: int):
    """The different values, numbered as they first appear; the number of each value; and which document has
    which, how often: the number of pairs per document, the steps from one number to the next, and the times."""
    unique, first, inverse = np.unique(values, return_index=True, return_inverse=True)
    by_first = np.argsort(first, kind="stable")
    number_of = np.empty(len(unique), np.int64)
    number_of[by_first] = np.arange(len(unique))
    own = number_of[inverse]
    pairs, times = np.unique(doc * max(len(unique), 1) + own, return_counts=True)
    pair_doc, pair_value = pairs // max(len(unique), 1), pairs % max(len(unique), 1)
    step = np.diff(pair_value, prepend=0)
    starts = np.flatnonzero(np.diff(pair_doc, prepend=-1))
    step[starts] = pair_value[starts]
    return unique[by_first], own, [np.bincount(pair_doc, minlength=n_docs), _packed(step), _packed(times)]


def _unpaired(n_pairs: np.ndarray, steps_: bytes, times: bytes):
    """The document, the number of the value and the times of each pair."""
    step, own = _unpacked(steps_), n_pairs[n_pairs > 0]
    first = np.cumsum(own) - own
    sums = np.cumsum(step)
    return np.repeat(np.arange(len(n_pairs)), n_pairs), sums - np.repeat(sums[first] - step[first], own), _unpacked(times)


def _block(number: int, docs: list, tokens: list, codes: list) -> pa.RecordBatch:
    """One row: the documents, their different tokens with the training count here, the different strings whose
    scores they lack, and which document has which."""
    doc_ids, held, n_tokens, n_bytes, score, n_codes = (np.concatenate([d[i] for d in docs]) if i else sum((d[0] for d in docs), []) for i in range(6))
    every = np.arange(len(doc_ids))
    doc = np.repeat(every, n_tokens)
    token, own, pairs = _pairs(np.concatenate(tokens), doc, len(doc_ids))
    trained = np.bincount(own, ~held[doc], len(token)).astype(np.int64)
    code, _, code_pairs = _pairs(np.concatenate(codes), np.repeat(every, n_codes), len(doc_ids))
    row = [number, doc_ids, held.tolist(), n_tokens, n_bytes, score, token.view(np.int64), trained, *pairs, code, *code_pairs]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)


def _blocks(batches, common: Common):
    part, number, docs, tokens, codes, size = TaskContext.get().partitionId() << 32, 0, [], [], [], 0
    for rows, data, offsets in steps(batches):
        size += len(data)
        data, starts, ends, first, row_bytes = _tokens(data, offsets)
        code, at = _codes(data, row_bytes)
        unique, which = np.unique(code, return_inverse=True)
        log10, here = common.look_up(unique)
        score = np.add.reduceat(log10[which], at[:-1], dtype=np.float64)
        lacking = np.flatnonzero(~here[which])
        n = np.diff(first)
        own = np.empty(len(starts) + len(n), np.uint64)
        is_end = np.zeros(len(own), bool)
        is_end[np.cumsum(n + 1) - 1] = True
        own[is_end] = _END_TOKEN
        own[~is_end] = range_hashes(prefix_sums(data), starts, ends)
        docs.append((rows.column("doc_id").to_pylist(), rows.column("held_out").to_numpy(zero_copy_only=False), n + 1, np.diff(at), score,
                     np.diff(np.searchsorted(lacking, at))))
        tokens.append(own)
        codes.append(code[lacking])
        if size >= BLOCK_BYTES:
            yield _block(part + number, docs, tokens, codes)
            number, docs, tokens, codes, size = number + 1, [], [], [], 0
    if docs:
        yield _block(part + number, docs, tokens, codes)


def _finish(batches, trained: int, vocabulary: int):
    for batch in batches:
        for row in range(len(batch)):
            get = lambda name: batch.column(name)[row].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            raw = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
            bytes_ = get("n_bytes")
            c = get("n").astype(np.int64)
            if batch.column("place")[row].is_valid:
                c[get("place")] = get("c")
            doc, token, times = _unpaired(get("n_pairs"), raw("steps"), raw("times"))
            p = np.log10((c + 0.1) / (trained + 0.1 * (vocabulary + 1)))
            base = np.bincount(doc, times * p[token], len(bytes_))
            known = np.bincount(doc, times * (c[token] > 0), len(bytes_)).astype(np.int64)
            score = get("score").copy()
            if batch.column("code_place")[row].is_valid:
                log10 = np.empty(len(get("code_place")))
                log10[get("code_place")] = get("code_log10")
                doc, code, times = _unpaired(get("code_n_pairs"), raw("code_steps"), raw("code_times"))
                score += np.bincount(doc, times * log10[code], len(bytes_))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[row].values, pa.array(get("held_out")), pa.array(get("n_tokens")), pa.array(known), pa.array(np.full(len(bytes_), trained)),
                 pa.array(base), pa.array(score), pa.array(bytes_), pa.array(-score / math.log10(2) / bytes_)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])


def scores(docs: DataFrame) -> DataFrame:
    """How probable each text of ``docs`` (``doc_id, text``) is, to the weighted tree and to the unigram base line.

    Texts are lower-cased (A-Z) and split at ASCII white space; an end follows the last word. The tree sees
    the words' bytes, a space after each, and the end. Returns per row ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score`` (log10), ``n_bytes`` of what the tree sees and ``bits_per_byte``, its
    code length. A null or empty text is an end alone. Documents that are not held out train both models; a
    row without doc_id does. Repeated rows count and are scored each time, other columns are ignored, an
    empty table gives an empty result. Tokens are told apart by 64-bit hashes.

    The base line needs the count of every token in all documents. Texts are taken in blocks, and a block asks
    for each of its different tokens once: a token has at most one row per block, however common it is. So do
    the strings of the tree that are not among the common ones.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    common, rest = _common(tree_scores(strings(rows)))
    sent = docs.sparkSession.sparkContext.broadcast(common)
    blocks = stored(rows.mapInArrow(lambda batches: _blocks(batches, sent.value), _BLOCK_SQL), "blocks")
    asked = blocks.select("block", F.posexplode(F.arrays_zip("token", "n")).alias("place", "x")).select("block", "place", "x.token", "x.n")
    # a common token's rows are added up before the shuffle, and the join can be split where one token has many
    counts = stored(asked.groupBy("token").agg(F.sum("n").alias("c"), F.count("*").alias("blocks")), "token_counts")
    known = counts.agg(F.sum("c").alias("tokens"), F.count_if(F.col("c") > 0).alias("kinds")).first()
    trained, vocabulary = known["tokens"] or 0, known["kinds"] or 0
    shared = asked.select("block", "place", "token").join(counts.where("blocks > 1").select("token", "c").hint("merge"), "token")
    answers = shared.groupBy("block").agg(F.collect_list(F.struct("place", "c")).alias("x")).select("block", F.col("x.place").alias("place"), F.col("x.c").alias("c"))
    # without the hint Spark would judge the exploded strings by the size of the lists' files, and might send them to all
    lacking = blocks.select("block", F.posexplode("code").alias("place", "code")).join(rest.hint("merge"), "code")
    lacking = lacking.groupBy("block").agg(F.collect_list(F.struct("place", "log10")).alias("x"))
    lacking = lacking.select("block", F.col("x.place").alias("code_place"), F.col("x.log10").alias("code_log10"))
    out = blocks.drop("token", "code").join(answers, "block", "left").join(lacking, "block", "left")
    return out.mapInArrow(lambda batches: _finish(batches, trained, vocabulary),
                          "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
