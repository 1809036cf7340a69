"""SentencePiece encoding of merge-type (BPE) vocabularies by a score-ordered agenda of adjacent symbol pairs.

A text is normalised as the model says (a space in front, spaces as U+2581) and split into characters. Every two
neighbours that together are a piece go on an agenda, best score first, leftmost first among equals. The best pair
is joined; the pairs of the new symbol with its neighbours are added. Symbols that are no piece at the end are
written as pieces of their UTF-8 bytes, or as the unknown piece.

Where no piece holds a space behind another character, no pair is ever joined across the front of a word's spaces.
A text is then cut there, and a word that was met before is looked up. The agendas of all new words of a step
advance together, as the rows of a matrix of pair scores; a long word has a heap of its own.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from realpay.llm.textbytes import steps

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: Words whose ids a worker remembers.
REMEMBERED = 1 << 18
#: Words of up to these lengths share a matrix, in blocks of so many rows; a longer one has a heap.
LENGTHS, ROWS = (6, 9, 14, 24, 48), 1 << 13
#: Bytes of text encoded at once.
STEP = 1 << 20

# Fixed values of the model file's format: field numbers and enum values.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_NORMAL, _UNKNOWN, _CONTROL, _USER_DEFINED, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_MODEL_TYPE, _BPE, _BYTE_FALLBACK, _SUFFIX = 3, 2, 35, 24
_CHARS_MAP, _DUMMY_PREFIX, _REMOVE_EXTRA, _ESCAPE = 2, 3, 4, 5


def _fields(message: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(message):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield number, message[at : at + size]
        at += size

#: A pair of symbols is one number; symbols are ids of pieces, or beyond them code points.
_SYMBOLS, _GONE, _NEVER = 1 << 31, (1 << 31) - 1, 1 << 31


@dataclass
class Vocabulary:
    """What encoding needs of a model file."""

    score: dict[str, float] = field(default_factory=dict)
    id: dict[str, int] = field(default_factory=dict)
    byte: list[int] = field(default_factory=lambda: [-1] * 256)
    unknown: int = 0
    size: int = 0
    prefix: bool = True
    cut: re.Pattern | None = None
    letter: np.ndarray | None = None
    letter_id: np.ndarray | None = None
    pair: np.ndarray | None = None
    pair_rank: np.ndarray | None = None
    by_rank: np.ndarray | None = None
    alike: re.Pattern | None = None
    remembered: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def _merged(self, text: str) -> list[str]:
        """The symbols of ``text`` after all merges."""
        symbols: list[str] = list(text)
        n, score = len(symbols), self.score
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            found = score.get(symbols[i] + symbols[i + 1])
            if found is not None:
                agenda.append((-found, i, i + 1, len(symbols[i]) + len(symbols[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            left, right = symbols[i], symbols[j]
            if not left or not right or len(left) + len(right) != size:
                continue
            symbols[i], symbols[j] = left + right, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = score.get(symbols[i] + symbols[k])
                if found is not None:
                    heapq.heappush(agenda, (-found, i, k, size + len(symbols[k])))
            k = before[i]
            if k >= 0:
                found = score.get(symbols[k] + symbols[i])
                if found is not None:
                    heapq.heappush(agenda, (-found, k, i, len(symbols[k]) + size))
        return [s for s in symbols if s]

    def _heap(self, text: str) -> tuple[int, ...]:
        """Ids of one word, by a heap of its pairs."""
        return tuple(chain.from_iterable((self.id[s],) if s in self.id else self._spelled(s) for s in self._merged(text)))

    def _spelled(self, symbol: str) -> tuple[int, ...]:
        return tuple(self.byte[b] for b in symbol.encode()) if self.byte[0] >= 0 else (self.unknown,)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of what ``left`` and ``right`` make among all pieces by score; :data:`_NEVER` where it is no piece."""
        wanted = left * _SYMBOLS + right
        at = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
        return np.where(self.pair[at] == wanted, self.pair_rank[at], _NEVER)

    def _together(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of ``words`` (none empty): in each round the best pair of every word is joined. A word is a column."""
        length = np.array([len(w) for w in words])
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.letter, code), len(self.letter) - 1)
        # a character that is no piece is a symbol beyond all pieces: its code point tells it
        code = np.where(self.letter[at] == code, self.letter_id[at], self.size + code)
        symbol = np.full((len(words), length.max() + 1), _GONE)
        symbol[np.arange(length.max() + 1) < length[:, None]] = code
        now = symbol = np.ascontiguousarray(symbol.T)
        rank = self._ranks(now[:-1], now[1:])
        place, word = np.arange(len(now))[:, None], np.arange(len(words))
        while True:
            best = rank.argmin(axis=0)
            goes_on = rank[best, np.arange(len(best))] < _NEVER
            if not goes_on.all():
                symbol[:, word[~goes_on]] = now[:, ~goes_on]
                if not goes_on.any():
                    break
                now, rank, best, word = now[:, goes_on], rank[:, goes_on], best[goes_on], word[goes_on]
            own = np.arange(len(best))
            joined = self.by_rank[rank[best, own]]
            behind = place > best
            new = np.full_like(now, _GONE)
            new[:-1] = np.where(behind[:-1], now[1:], now[:-1])
            new[best, own] = joined
            ranks = np.full_like(rank, _NEVER)
            ranks[:-1] = np.where(behind[:-2], rank[1:], rank[:-1])
            ranks[best, own] = self._ranks(joined, new[best + 1, own])
            inner = np.flatnonzero(best)
            before = best[inner] - 1
            ranks[before, inner] = self._ranks(new[before, inner], joined[inner])
            now, rank = new, ranks
        out = []
        for line, n in zip(symbol.T.tolist(), (symbol != _GONE).sum(axis=0).tolist()):
            line = line[:n]
            if max(line) < self.size:
                out.append(tuple(line))
            else:
                out.append(tuple(chain.from_iterable((x,) if x < self.size else self._spelled(chr(x - self.size)) for x in line)))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; none for an empty one."""
        front = SPACE if self.prefix else ""
        texts = [front + x.replace(" ", SPACE) if x else "" for x in texts]
        words = [self.cut.findall(x) if self.cut else [x] if x else [] for x in texts]
        known = self.remembered
        new = list(set(chain.from_iterable(words)).difference(known))
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set(chain.from_iterable(words)))
        long = [w for w in new if len(w) > LENGTHS[-1] or self.alike and self.alike.search(w)]
        new = sorted(set(new).difference(long), key=len)
        ends = np.searchsorted([len(w) for w in new], LENGTHS, "right").tolist()
        for low, high in zip((0, *ends), ends):
            for i in range(low, high, ROWS):
                some = new[i : min(i + ROWS, high)]
                known.update(zip(some, self._together(some)))
        known.update((w, self._heap(w)) for w in long)
        out = [list(chain.from_iterable(map(known.__getitem__, line))) for line in words]
        for w in long:
            del known[w]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str = MODEL) -> Vocabulary:
    """Read a model file. A model that is not of merge type, or whose normalisation needs more than a space in
    front and spaces as U+2581, is an error: other texts than the library's would be encoded."""
    with open(path, "rb") as file:
        parts = list(_fields(file.read()))
    trainer = dict(chain.from_iterable(_fields(v) for number, v in parts if number == _TRAINER))
    normalizer = dict(chain.from_iterable(_fields(v) for number, v in parts if number == _NORMALIZER))
    if trainer.get(_MODEL_TYPE, 1) != _BPE:
        raise ValueError(f"{path}: not a merge-type vocabulary")
    if normalizer.get(_CHARS_MAP) or normalizer.get(_REMOVE_EXTRA, 1) or not normalizer.get(_ESCAPE, 1) or trainer.get(_SUFFIX, 0):
        raise ValueError(f"{path}: needs a normalisation that is not supported")
    out = Vocabulary(prefix=bool(normalizer.get(_DUMMY_PREFIX, 1)), size=sum(number == _PIECES for number, _ in parts))
    for number, (_, value) in enumerate(p for p in parts if p[0] == _PIECES):
        piece = dict(_fields(value))
        text, kind = piece[1].decode(), piece.get(3, _NORMAL)
        if kind in (_USER_DEFINED, _UNUSED):
            raise ValueError(f"{path}: piece {text!r} is of a kind that is not supported")
        if kind == _UNKNOWN:
            out.unknown = number
        elif kind == _BYTE and trainer.get(_BYTE_FALLBACK, 0):
            out.byte[int(text[3:5], 16)] = number
        elif kind == _NORMAL:
            out.id[text] = number
            out.score[text] = float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0])
    letters = sorted((ord(p), n) for p, n in out.id.items() if len(p) == 1)
    out.letter, out.letter_id = np.array(letters, np.int64).reshape(-1, 2).T
    made = {p[:i] + p[i:]: None for p in out.id for i in range(1, len(p)) if p[:i] in out.id and p[i:] in out.id}
    best_first = sorted(made, key=lambda p: (-out.score[p], out.id[p]))
    # of equal scores the leftmost goes first, whatever its piece; a rank can't say that
    shared = Counter(out.score[p] for p in made)
    alike = sorted({re.escape(p[:2]) for p in made if shared[out.score[p]] > 1})
    out.alike = re.compile("|".join(alike)) if alike else None
    rank = {p: i for i, p in enumerate(best_first)}
    out.by_rank = np.array([out.id[p] for p in best_first])
    pairs = sorted((out.id[p[:i]] * _SYMBOLS + out.id[p[i:]], rank[p]) for p in out.id for i in range(1, len(p)) if p[:i] in out.id and p[i:] in out.id)
    out.pair, out.pair_rank = np.array(pairs, np.int64).T.copy()
    joined = [p for p in out.id if len(p) > 1]
    if not any(SPACE in p.lstrip(SPACE) for p in joined):
        # white space that is part of no longer piece stands alone; a word begins where its spaces begin
        alone = "".join(sorted(set("\t\n\v\f\r").difference(*joined)))
        some = f"[{alone}]+|" if alone else ""
        out.cut = re.compile(f"{some}{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")
    return out


@lru_cache(maxsize=2)
def _library(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _texts(rows: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in rows.column(column).to_pylist()]


def _id_lists(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
    flat = np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


def _encoded(batches, id_column, text_column, path):
    encode, library = vocabulary(path).encode, _library(path)
    for rows, _, _ in steps(batches, text_column, STEP):
        ids = encode(_texts(rows, text_column))
        yield pa.RecordBatch.from_arrays([rows.column(id_column).cast(pa.int64()), _id_lists(ids), pa.array(library.decode(ids), pa.string())],
                                         names=["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = MODEL) -> DataFrame:
    """``doc_id, ids, decoded`` for each row of ``docs``: the ids of the whole text without begin and end, and what the
    library decodes them to.

    A null text is empty; an empty one has no ids and decodes to nothing. A null doc_id stays null, a repeated row
    gives a row each time, other columns are ignored, an empty table gives an empty result. ``path`` is the model
    file on every machine. Rows are encoded where they are read, in steps of about 1 MB; a longer text is a step
    of its own.
    """
    return docs.select(id_column, text_column).mapInArrow(
        lambda batches: _encoded(batches, id_column, text_column, path), "doc_id long, ids array<int>, decoded string")


def _differing(batches, id_column, text_column, path):
    encode, library = vocabulary(path).encode, _library(path)
    for rows, _, _ in steps(batches, text_column, STEP):
        texts = _texts(rows, text_column)
        ids, theirs = encode(texts), library.encode(texts, num_threads=1)
        other = [i for i, (a, b) in enumerate(zip(ids, theirs)) if a != b]
        yield pa.RecordBatch.from_arrays(
            [rows.column(id_column).cast(pa.int64()).take(pa.array(other, pa.int64())), _id_lists([ids[i] for i in other]), _id_lists([theirs[i] for i in other])],
            names=["doc_id", "ids", "library_ids"])


def differing(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = MODEL) -> DataFrame:
    """The rows whose ids are not those of the sentencepiece library, as ``doc_id, ids, library_ids``: empty when all
    is well. Encodes every text both ways, batch by batch."""
    return docs.select(id_column, text_column).mapInArrow(
        lambda batches: _differing(batches, id_column, text_column, path), "doc_id long, ids array<int>, library_ids array<int>")


def digests(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the rows of :func:`encode`."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
