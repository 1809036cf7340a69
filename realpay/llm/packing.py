"""Bounded-space online packing of tokens into windows.

Each partition keeps a fixed number of open windows. What is left of a document after its full windows goes
to the open window it fits best; when it fits in none, the fullest is filled up with its first tokens and
emitted, and the rest is placed again. What the partitions leave open is merged at the end.
"""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from realpay.llm.tables import stored
from realpay.llm.textbytes import steps

#: The vocabulary of byte_bpe_50k.json as ranks: the same ids, several times as fast.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = {"<|endoftext|>": 50256}
WINDOW, OPEN_WINDOWS, END_ID = 1024, 8, 0
#: Partitions whose leftovers are merged by one task.
MERGE = 64

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """What ``Tokenizer.from_file(path("byte_bpe_50k.json")).encode(text, add_special_tokens=False)`` gives.

    As there, the string of a special token in the text is that token.
    """
    encoding = _encoding(vocabulary)
    return np.array(encoding.encode(text, allowed_special="all") if "<|" in text else encoding.encode_ordinary(text), dtype="<u4")


class _Windows:
    """The open windows of one partition. A piece is [doc_id, start, ids, doc_tokens]."""

    def __init__(self, window: int, most: int, first_id: int):
        self.window, self.most, self.next_id, self.open, self.done = window, most, first_id, [], []

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.done.append((doc_id, start, len(ids), ids, doc_tokens, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def put(self, piece: list) -> None:
        doc_id, start, ids, doc_tokens = piece
        fits = [x for x in self.open if x[0] >= len(ids)]
        if fits:
            best = min(fits, key=lambda x: x[0])
        elif len(self.open) < self.most:
            self.open.append(best := [self.window, []])
        else:
            best = min(self.open, key=lambda x: x[0])
        cut = min(best[0], len(ids))
        best[0] -= cut
        best[1].append([doc_id, start, ids[:cut], doc_tokens])
        if not best[0]:
            self.open.remove(best)
            self.emit(best[1])
        if cut < len(ids):
            self.put([doc_id, start + cut, ids[cut:], doc_tokens])

    def add(self, doc_id, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for start in range(0, whole, self.window):
            self.emit([[doc_id, start, ids[start : start + self.window], len(ids)]])
        if whole < len(ids):
            self.put([doc_id, whole, ids[whole:], len(ids)])

    def merge(self, pieces: list) -> list:
        """Fill windows with ``pieces`` in order; what does not fill one."""
        left, room = [], self.window
        for doc_id, start, ids, doc_tokens in pieces:
            while len(ids):
                cut = min(room, len(ids))
                left.append([doc_id, start, ids[:cut], doc_tokens])
                start, ids, room = start + cut, ids[cut:], room - cut
                if not room:
                    self.emit(left)
                    left, room = [], self.window
        return left

    def finish(self) -> list:
        pieces = [piece for _, own in sorted(self.open, key=lambda x: x[0]) for piece in own]
        self.open = []
        return self.merge(pieces)


def _frame(rows: list, with_ids: bool) -> pd.DataFrame:
    columns = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    out = pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
    out["ids_crc32"] = [zlib.crc32(x.tobytes()) for x in out["ids"]]
    out["ids"] = [x.tobytes() if with_ids else None for x in out["ids"]]
    return out


def _pack_partition(batches, id_column, text_column, window, most, end_id, vocabulary, with_ids):
    part = TaskContext.get().partitionId()
    windows = _Windows(window, most, part << 32)
    for rows, data, offsets in steps(batches, text_column):
        for doc_id, text in zip(rows.column(id_column).to_pylist(), rows.column(text_column).to_pylist()):
            windows.add(doc_id, np.append(token_ids(text or "", vocabulary), np.uint32(end_id)).astype("<u4"))
        if windows.done:
            yield _frame(windows.done, with_ids).assign(part=None)
            windows.done = []
    left = windows.finish()
    if windows.done:
        yield _frame(windows.done, with_ids).assign(part=None)
    if left:
        yield _frame([(d, s, len(ids), ids, n, None, i) for i, (d, s, ids, n) in enumerate(left)], True).assign(part=part)


def _arrow(frames):
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("part", pa.int64())])
    for frame in frames:
        yield pa.RecordBatch.from_pandas(frame[schema.names], schema, preserve_index=False)


def _merge_group(rows: pd.DataFrame, window: int, with_ids: bool) -> pd.DataFrame:
    rows = rows.sort_values(["part", "offset"])
    windows = _Windows(window, 0, 1 << 62 | int(rows["part"].iloc[0]) // MERGE << 32)
    doc_ids = [None if pd.isna(x) else int(x) for x in rows["doc_id"]]
    left = windows.merge([[d, s, np.frombuffer(ids, "<u4"), n] for d, s, ids, n in zip(doc_ids, rows["start"], rows["ids"], rows["doc_tokens"])])
    rest = sum(len(x[2]) for x in left)
    while rest:  # the last window in powers of two, which take no padding
        windows.window = 1 << rest.bit_length() - 1
        left = windows.merge(left)
        rest -= windows.window
    return _frame(windows.done, with_ids)


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, open_windows: int = OPEN_WINDOWS,
         end_id: int = END_ID, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """The pieces that the documents are cut into and the sequences they lie in.

    Returns per piece ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and ``ids``
    (little-endian unsigned 32-bit) with ``with_ids``. A document is the ids of its text and ``end_id``; a null
    or empty text is ``end_id`` alone. Every sequence is full (``window`` tokens) but for at most log2(window)
    per ``MERGE`` partitions, whose lengths are powers of two; so no sequence needs padding. A null doc_id
    stays null, a repeated row is packed each time, other columns are ignored, an empty table gives no piece.

    A partition holds ``open_windows`` windows and one step of texts in memory. It leaves less than one window;
    the leftovers of ``MERGE`` partitions are merged by one task.
    """
    rows = docs.select(id_column, text_column).mapInArrow(
        lambda batches: _arrow(_pack_partition(batches, id_column, text_column, window, open_windows, end_id, vocabulary, with_ids)), f"{_PIECES}, ids binary, part long")
    rows = stored(rows, "pieces")
    merged = rows.where("part is not null").groupBy(F.floor(F.col("part") / MERGE).alias("g")).applyInPandas(
        lambda g: _merge_group(g, window, with_ids), f"{_PIECES}, ids binary")
    columns = [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids
    return rows.where("part is null").select(columns).unionByName(merged.select(columns))


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """``sequence_id, length, ids``: the sequences themselves, from :func:`pack` with ``with_ids``.

    Padded with ``pad_id`` to ``window``, except at a power of two.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(rows.sort_values("offset")["ids"]), "<u4")
        pad = 0 if len(ids).bit_count() == 1 else window - len(ids)
        return pd.DataFrame({"sequence_id": rows["sequence_id"].iloc[:1], "length": [len(ids)], "ids": [np.append(ids, [pad_id] * pad).astype(int).tolist()]})

    return pieces.groupBy("sequence_id").applyInPandas(one, "sequence_id long, length long, ids array<int>")
