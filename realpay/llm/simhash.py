"""Near copies by SimHash, found with covering locality-sensitive hashing.

A document's fingerprint takes each bit by majority over the XXH64 hashes of its word shingles. Documents
link when their fingerprints differ in at most ``radius`` bits. Covering LSH (Pagh, "CoveringLSH", 2016)
gives every bit position a nonzero vector of ``radius + 1`` bits; table ``v`` keeps the positions whose
vector has an odd overlap with ``v``. Up to ``radius`` differing positions span less than the whole space, so some ``v``
is orthogonal to all of them and that table drops exactly these bits: every pair within the radius meets in
a table, with no chance of a miss.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from realpay.llm.components import components
from realpay.llm.tables import stored, without
from realpay.llm.textbytes import LOWER, NOT_SPACE, joined_words, steps, words

BITS = 64
#: Fingerprints that are compared pair by pair in one bucket; beyond it, see :func:`_large_buckets`.
BUCKET = 512
#: Shingles whose bits are counted at once.
BLOCK = 1 << 17


def masks(radius: int) -> list[int]:
    """The bits that each table keeps."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(BITS)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row, the bits set in over half of hashes[first[i]:first[i + 1]]; zero for none."""
    total = np.zeros((len(first) - 1, BITS), dtype=np.int64)
    for low in range(0, len(hashes), BLOCK):
        high = min(low + BLOCK, len(hashes))
        bits = np.unpackbits(hashes[low:high].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        cut = np.clip(first, low, high) - low
        rows = np.flatnonzero(cut[1:] > cut[:-1])
        total[rows] += np.add.reduceat(bits, cut[rows], axis=0, dtype=np.int64)
    return np.packbits(2 * total > np.diff(first)[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def _fingerprints(batches, id_column, text_column, shingle):
    for rows, data, offsets in steps(batches, text_column):
        starts, ends, first = words(data := LOWER[data], offsets, NOT_SPACE)
        data, starts, ends = joined_words(data, starts, ends)
        per_row = np.diff(first)
        count = np.where(per_row >= shingle, per_row - shingle + 1, per_row > 0)
        begin = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        last = np.minimum(begin + shingle, np.repeat(first[1:], count)) - 1
        text = data.tobytes()
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter((h(text[s:e], 42) for s, e in zip(starts[begin].tolist(), ends[last].tolist())), np.uint64, len(begin))
        prints = _majority(hashes, np.concatenate([[0], np.cumsum(count)]))
        yield pa.RecordBatch.from_arrays([rows.column(id_column).cast(pa.int64()), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of each row."""
    return docs.select(id_column, text_column).mapInArrow(
        lambda batches: _fingerprints(batches, id_column, text_column, shingle), "doc_id long, fp long")


def _bucket_edges(batches, radius):
    """Edges from each member of a bucket to the first of those it is connected with inside the bucket."""
    for batch in batches:
        u, v = [], []
        for members in batch.column(0).to_pylist():
            x = np.array(members, dtype=np.int64).view(np.uint64)
            near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
            label, before = np.arange(len(x)), None
            while before is None or (label != before).any():
                before, label = label, np.where(near, label[None, :], len(x)).min(axis=1)
            other = np.flatnonzero(label != np.arange(len(x)))
            u.append(x[other])
            v.append(x[label[other]])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (u, v)], names=["u", "v"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _large_buckets(rows: DataFrame, radius: int) -> DataFrame:
    """Edges inside buckets of any size, without comparing all pairs.

    Members of a bucket differ only in the bits its table drops. Each member gives one key for every choice
    of ``radius`` dropped bits, itself with these bits cleared: two members within the radius share one of
    those keys, and a key has at most 2**radius different members. (radius 2: 27 or 28 bits, 378 keys at most.)
    """
    out = None
    for t, mask in enumerate(masks(radius)):
        dropped = [i for i in range(BITS) if not mask >> i & 1]
        clear = [_signed(~sum(1 << i for i in c) & (1 << BITS) - 1) for c in itertools.combinations(dropped, radius)]
        own = rows.where(F.col("t") == t).select("fp", F.explode(F.array(*map(F.lit, clear))).alias("clear"))
        own = own.groupBy("clear", F.col("fp").bitwiseAND(F.col("clear")).alias("rest")).agg(F.collect_set("fp").alias("all"))
        own = own.where(F.size("all") > 1).select(F.array_min("all").alias("u"), F.explode("all").alias("v"))
        out = own if out is None else out.unionByName(own)
    return out


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``u, v`` between different fingerprints that connect all of those within ``radius`` bits.

    ``prints`` has one row per different fingerprint. Within a bucket the edges are a spanning forest of the
    links, so a bucket gives fewer edges than it has members.
    """
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks(radius))))
    rows = prints.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    rows = stored(rows.join(sizes, ["t", "key"]), "buckets")
    small = rows.where(F.col("size") <= BUCKET).groupBy("t", "key").agg(F.collect_list("fp").alias("members")).select("members")
    edges = small.mapInArrow(lambda batches: _bucket_edges(batches, radius), "u long, v long")
    large = rows.where(F.col("size") > BUCKET)
    return edges if large.isEmpty() else edges.unionByName(_large_buckets(large, radius))


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Texts are lower-cased (A-Z) and split at ASCII white space; shingles are ``shingle`` words, repeats count,
    a shorter text is one shingle. A text without words, or null, has fingerprint zero, which links like any
    other. ``component_id`` is the least doc_id that chains of links reach, itself included. Rows without
    doc_id take part but can't be the least; a component of such rows alone has a null id. A repeated row
    gives a row each time. Other columns of ``docs`` are ignored. An empty table gives an empty result.

    Equal fingerprints are one node of the graph, so a group of copies of any size costs one node.
    """
    own = stored(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(links(nodes.select("fp"), radius))
    labelled = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    labelled = stored(labelled, "labels")
    ids = labelled.join(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("fp", "component_id")
    return own.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component, the document with the least doc_id.

    Of rows that repeat a doc_id, the one that sorts first by its columns. Rows without doc_id stay: nothing tells
    which of them to keep.
    """
    found = stored(near_copies(docs, shingle=shingle, radius=radius).where("doc_id is not null"), "components")
    ids = stored(found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n"))
                 .where("NOT stays OR n > 1"), "copies")
    # an id that repeats is settled by itself: only its rows move
    twice = ids.where("stays AND n > 1").select(F.col("doc_id").alias("_rp_id"))
    one = Window.partitionBy("doc_id").orderBy(*docs.columns)
    again = docs.join(twice, docs["doc_id"] == F.col("_rp_id"), "left_semi").withColumn("_rp_row", F.row_number().over(one)).where("_rp_row = 1")
    return without(docs, {"doc_id": docs["doc_id"]}, ids.select("doc_id")).unionByName(again.select(docs.columns))
