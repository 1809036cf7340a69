"""Grouping of spelling variants with a frequency-vector trie.

A word is described by how often each of some groups of letters occurs in it; the counts, one after the other, are its
path in a trie. One inserted letter adds one to one count, a deleted one takes one off, a replaced one does both (or
neither, within a group). So from a word, a depth-first search with a budget of one surplus and one deficit meets all
words that one edit makes of it, and those that it meets at the leaves are compared letter by letter.

The trie is dealt over Spark by its upper levels: a node is as deep as it must be to hold few words. A word is a
member of its own node and visits those that the budget reaches. Of two near words only one finds the other: in the
first group where their counts differ, the visitor has one less. Inside a node the search takes all its visitors
along, so every trie node is walked once for thousands of words.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from realpay.llm.tables import shuffle_partitions, stored
from realpay.llm.textbytes import LOWER, mix, steps, words

#: Letters whose counts are the levels of the trie, the most telling first; all other letters are the last level.
GROUPS = ("e", "n", "i", "r", "t", "s", "a", "h", "u", "o", "l", "d", "c", "m", "gbp")
#: Words of a node of the dealt trie at most; a leaf of more is dealt in parts.
NODE = 50_000
#: A range of members and visitors this large is compared at once, whatever its level.
PAIRS = 1 << 16
#: Different words a task counts before it hands the counts on.
HELD = 1 << 18
#: Words up to this length are compared in a matrix.
WIDTH = 48

#: A byte for the second half of U+00C0 to U+00FF; it occurs in no UTF-8 text.
_SECOND = 0xFF
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[[0xC3, _SECOND]] = True


def _counts(batches, id_column, text_column, every, shortest):
    held = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for rows, data, offsets in steps(batches, text_column):
        data = LOWER[data]
        shape = data.copy()
        shape[1:][data[:-1] == 0xC3] = _SECOND
        starts, ends, first = words(shape, offsets, _LETTER)
        seconds = np.concatenate([[0], np.cumsum(shape == _SECOND)])
        length = ends - starts - (seconds[ends] - seconds[starts])
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        long = length >= shortest
        starts, ends, row, length = starts[long], ends[long], row[long], length[long]
        text = data.tobytes()
        runs = [text[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
        if every:
            heads = np.array([zlib.crc32(b"%b:" % (b"" if i is None else b"%d" % i)) for i in rows.column(id_column).cast(pa.int64()).to_pylist()], dtype=np.int64)
            sums = np.fromiter(map(zlib.crc32, runs, heads[row].tolist()), np.int64, len(runs))
            for i in np.flatnonzero(sums % every == 0).tolist():
                run, at = runs[i].decode(), int(sums[i] % length[i])
                runs[i] = (run[:at] + run[at + 1 :]).encode() if length[i] > shortest else b""
        held.update(runs)
        held.pop(b"", None)
        if len(held) >= HELD:
            yield out()
            held.clear()
    yield out()


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", every: int = 0, shortest: int = 6, least: int = 5) -> DataFrame:
    """``word, n``: runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, of ``shortest`` letters and ``least`` occurrences.

    ``every`` damages runs first: where it divides the crc32 of ``doc_id:run``, the letter at that sum modulo the
    run's length is left out (a null doc_id is empty). 0 leaves all as they are.
    """
    own = docs.select(id_column, text_column).mapInArrow(lambda batches: _counts(batches, id_column, text_column, every, shortest), "word string, n long")
    return own.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class _Words:
    """Words as arrays: letters from the left and from the right, and their counts by group."""

    def __init__(self, column: pa.Array, groups):
        self.text = column.to_pylist()
        raw = [x.encode("latin-1") for x in self.text]
        self.length = np.array([len(x) for x in raw], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        row = np.repeat(np.arange(len(raw)), self.length)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        of = np.full(256, len(groups))
        for i, letters in enumerate(groups):
            of[list(letters.encode("latin-1"))] = i
        self.vector = np.bincount(row * (len(groups) + 1) + of[flat], minlength=len(raw) * (len(groups) + 1)).reshape(len(raw), -1)
        self.left, self.right = np.zeros((2, len(raw), WIDTH), np.uint8)
        short = self.length[row] <= WIDTH
        self.left[row[short], place[short]] = flat[short]
        self.right[row[short], (self.length[row] - 1 - place)[short]] = flat[short]

    def __len__(self):
        return len(self.text)


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes ``b`` of ``a``."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i, short = 0, min(len(a), len(b))
    while i < short and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _verified(visitors: _Words, members: _Words, v: np.ndarray, m: np.ndarray):
    """The near pairs among the given ones."""
    longest = np.maximum(visitors.length[v], members.length[m])
    wide = longest > WIDTH
    good = np.zeros(len(v), dtype=bool)
    for i in np.flatnonzero(wide).tolist():
        good[i] = near(visitors.text[v[i]], members.text[m[i]])
    a, b = v[~wide], m[~wide]
    differs = visitors.left[a] != members.left[b]
    front = np.where(differs.any(axis=1), differs.argmax(axis=1), WIDTH)
    differs = visitors.right[a] != members.right[b]
    good[~wide] = (longest[~wide] - front - differs.argmax(axis=1) <= 1) & (front < WIDTH) & (abs(visitors.length[a] - members.length[b]) <= 1)
    return v[good], m[good]


def search(visitors: _Words, members: _Words):
    """Yield pairs (indices of visitors, indices of members) of near words. Of words with equal counts only the one
    that sorts first finds the other; else the one with less in the first group that differs."""
    order = np.lexsort(members.vector.T[::-1])
    vector, levels = members.vector[order], members.vector.shape[1]

    def compare(low, high, level, who, surplus, deficit):
        rest = vector[low:high, level:]
        some = max(1, PAIRS // (high - low))
        for i in range(0, len(who), some):
            w, s, d = who[i : i + some], surplus[i : i + some], deficit[i : i + some]
            change = rest[None] - visitors.vector[w, level:][:, None]
            up, down = change > 0, change < 0
            ok = ((change * up).sum(axis=2) + s[:, None] <= 1) & (d[:, None] - (change * down).sum(axis=2) <= 1)
            if level < levels:
                # a deficit counts only behind the surplus
                first_down = np.where(down.any(axis=2), down.argmax(axis=2), levels)
                ok &= s[:, None] | (first_down == levels) | (up.any(axis=2) & (up.argmax(axis=2) < first_down))
            v, m = np.nonzero(ok)
            equal = ~s[v] & ~up[v, m].any(axis=1)
            v, m = w[v], order[low + m]
            keep = np.array([not e or visitors.text[x] < members.text[y] for e, x, y in zip(equal.tolist(), v.tolist(), m.tolist())], dtype=bool)
            if keep.any():
                yield _verified(visitors, members, v[keep], m[keep])

    def descend(low, high, level, who, surplus, deficit):
        if not len(who):
            return
        if level == levels or (high - low) * len(who) <= PAIRS:
            yield from compare(low, high, level, who, surplus, deficit)
            return
        column = vector[low:high, level]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1, [high - low]])
        own = visitors.vector[who, level]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            change = column[a] - own
            more, less = (change == 1) & ~surplus, (change == -1) & surplus & ~deficit
            on = np.flatnonzero((change == 0) | more | less)
            yield from descend(low + a, low + b, level + 1, who[on], surplus[on] | more[on], deficit[on] | less[on])

    if len(members) and len(visitors):
        none = np.zeros(len(visitors), dtype=bool)
        yield from descend(0, len(members), 0, np.arange(len(visitors)), none, none)


_PAIRS_ARROW = pa.schema([("word", pa.string()), ("other", pa.string()), ("n", pa.int64())])


def _searched(batches, groups):
    """Rows (node, part, visits, word, n), sorted by the first three: a node's members come before its visitors."""
    node, held, members = None, [], None

    def found(rows: pa.Table):
        nonlocal members
        if members is None:
            own = pa.concat_tables(held).combine_chunks() if held else None
            members = (_Words(own.column("word").combine_chunks(), groups), np.asarray(own.column("n"))) if own is not None else ()
        if not members:
            return
        known, count = members
        visitors, counts = _Words(rows.column("word").combine_chunks(), groups), np.asarray(rows.column("n"))
        for v, m in search(visitors, known):
            if len(v):
                a, b = [visitors.text[i] for i in v.tolist()], [known.text[i] for i in m.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(a + b, pa.string()), pa.array(b + a, pa.string()), pa.array(np.concatenate([count[m], counts[v]]))], schema=_PAIRS_ARROW)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        name = np.stack([np.asarray(table.column(c)).astype(np.int64) for c in ("node", "part", "visits")])
        visits = name[2]
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(name) != 0).any(axis=0)) + 1, [len(visits)]])
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if (own := tuple(name[:2, low])) != node:
                node, held, members = own, [], None
            if visits[low]:
                yield from found(table.slice(low, high - low))
            else:
                held.append(table.slice(low, high - low))


def _paths(batches, groups):
    for batch in batches:
        path = _Words(batch.column("word"), groups).vector
        offsets = np.arange(len(path) + 1, dtype=np.int32) * path.shape[1]
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(path.ravel().astype(np.int32)))], names=["path"])


def _dealt(batches, groups, depth):
    """Each word as a member of its node and as a visitor of those that the budget reaches in the upper ``depth`` levels.

    A node's name is a sum over its counts, each times a constant of its level, so one more or less is one constant
    more or less.
    """
    constant = mix(np.arange(1, depth + 1, dtype=np.uint64))
    for batch in batches:
        path = _Words(batch.column("word"), groups).vector[:, :depth]
        own = (path.astype(np.uint64) * constant).sum(axis=1, dtype=np.uint64)
        every = np.arange(len(path))
        node, visits, row = [own, own], [False, True], [every, every]
        for i in range(depth):
            node.append(own + constant[i])
            row.append(every)
            for j in range(i + 1, depth):
                some = np.flatnonzero(path[:, j])  # no word has less than none of a letter
                node.append(own[some] + constant[i] - constant[j])
                row.append(some)
        visits += [True] * (len(node) - 2)
        for low in range(0, len(node), 8):  # a few copies of the batch at a time
            n, v, r = (x[low : low + 8] for x in (node, visits, row))
            take = pa.array(np.concatenate(r))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(n).view(np.int64)), pa.array(np.repeat(v, [len(x) for x in n])), batch.column("word").take(take), batch.column("n").take(take)],
                names=["node", "visits", "word", "n"])


def near_words(counted: DataFrame, groups=GROUPS, node: int = NODE) -> DataFrame:
    """``word, other, n``: for each word of ``counted`` (``word, n``, distinct) every near word and its count."""
    levels = len(groups) + 1
    # the least depth at which no node holds too many words
    sizes = counted.select("word").mapInArrow(lambda batches: _paths(batches, groups), "path array<int>").groupBy("path").agg(F.count("*").alias("m"))
    sizes = sizes.select(F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("depth"), "path", "m")
    sizes = sizes.groupBy("depth", F.slice("path", F.lit(1), F.col("depth")).alias("path")).agg(F.sum("m").alias("m"))
    largest = {r["depth"]: (r["m"], r["total"]) for r in sizes.groupBy("depth").agg(F.max("m").alias("m"), F.sum("m").alias("total")).collect()}
    total = largest.get(1, (0, 0))[1]
    few = min(node, max(total // (4 * shuffle_partitions(counted.sparkSession)), 1000))
    depth = next((d for d in range(1, levels + 1) if largest.get(d, (0, 0))[0] <= few), levels)

    rows = counted.select("word", "n").mapInArrow(lambda batches: _dealt(batches, groups, depth), "node long, visits boolean, word string, n long")
    rows = rows.withColumn("part", F.lit(0))
    if largest.get(depth, (0, 0))[0] > node:
        # a leaf of too many words: its members are dealt in parts, and its visitors go to each of them
        parts = rows.where("NOT visits").groupBy("node").agg(F.ceil(F.count("*") / node).cast("int").alias("parts")).where("parts > 1")
        every = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
        own = F.array(F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int"))
        rows = rows.drop("part").join(parts, "node", "left").select("node", "visits", "word", "n", F.explode(F.when(F.col("visits"), every).otherwise(own)).alias("part"))
    rows = rows.repartition("node", "part").sortWithinPartitions("node", "part", "visits")
    return rows.mapInArrow(lambda batches: _searched(batches, groups), "word string, other string, n long")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the end of each chain, by doubling the steps taken."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stored(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", every: int = 0, shortest: int = 6, least: int = 5, ratio: int = 5,
             groups=GROUPS, node: int = NODE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of :func:`word_counts`.

    Words are near if one inserted, deleted or replaced letter makes one of the other. ``form`` is the near word that
    occurs most (of equals the least in code-point order) if it occurs ``ratio`` times as often, else null; ``root`` is
    where the forms lead in the end, the word itself without a form. A null text has no words, a repeated row counts
    each time, other columns are ignored; an empty table gives an empty result.

    Only counted words are shuffled. A word has a bounded number of near words, so no word gathers many rows.
    """
    counted = stored(word_counts(docs, id_column, text_column, every, shortest, least), "words")
    best = near_words(counted, groups, node).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "other")).alias("best"))
    fits = -F.col("best.n") >= ratio * F.col("n")
    out = stored(counted.join(best, "word", "left").select(
        "word", F.when(fits, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, -F.col("best.n")).alias("form_n")), "variants")
    roots = _roots(out.where("form IS NOT NULL"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
