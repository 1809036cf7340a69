"""Repair of conversations by a parallel Viterbi search with rank convergence.

A repair gives every row one edit (keep, change the role, delete) and may insert rows, so that the initials of the
roles read ``(s?(ua)+)?``. The cheapest repair is a shortest path through four states (nothing yet, after the system
row, after a user, after an assistant). Costs run backwards: a vector holds what each state still costs to the end.

Rows are sorted and cut into blocks of consecutive rows of one conversation. A conversation inside one block is
solved there. Blocks of longer ones start at once from a speculative vector, that of an end. A block's true vector is
what the block behind it gives; where that differs from the one used by more than a constant, the block runs again,
but only until its vectors differ from the earlier ones by a constant (rank convergence), since all before stays as
it is (Maleki, Musuvathi, Mytkowicz, "Parallelizing dynamic programming through rank convergence", 2014). Passes
repeat until no block needs one. The stitched costs then tell, from the front, the least of the cheapest edits.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from realpay.llm.tables import stored

# Costs of the edits, and of a truncated row that stays.
RE_ROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACES = " \t\n\v\f\r"

#: Rows and characters of a block.
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 20

_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEVER = 1 << 40
#: The state that a row with this initial leads to, if it may stand there; what an inserted or changed row leads to.
_STEP = {(_NOTHING, 0): _SYSTEM, (_NOTHING, 1): _USER, (_SYSTEM, 1): _USER, (_USER, 2): _ASSISTANT, (_ASSISTANT, 1): _USER}
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = ("user", "user", "assistant", "user")
_INITIAL = {"s": 0, "u": 1, "a": 2}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
#: A row's code: its initial (3: any other), 4 if truncated, 8 if it must go.
_CUT, _GOES = 4, 8


def _closed(v) -> tuple[int, ...]:
    """With rows inserted first wherever that is cheaper."""
    user, assistant = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return min(v[0], INSERT + user), min(v[1], INSERT + user), user, assistant


END = _closed((0, _NEVER, _NEVER, 0))


@lru_cache(maxsize=None)
def _costs(code: int, behind: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a row, from those behind it."""
    out = [DELETE + x for x in behind]
    if not code & _GOES:
        cut = TRUNCATED if code & _CUT else 0
        for state in range(4):
            to = _STEP.get((state, code & 3))
            kept = _NEVER if to is None else behind[to]
            out[state] = min(out[state], cut + kept, cut + RE_ROLE + behind[_NEXT[state]])
    return _closed(out)


@lru_cache(maxsize=None)
def _back(code: int, behind: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """:func:`_costs` less their least, and the least. Few vectors occur, as inserts bound their differences."""
    costs = _costs(code, behind)
    least = min(costs)
    return tuple(x - least for x in costs), least


@lru_cache(maxsize=None)
def _edits(code: int, behind: tuple[int, ...], state: int) -> tuple[str, int]:
    """The least letters among the cheapest edits up to and with a row, and the state they lead to."""
    costs, letters = _costs(code, behind), ""
    while True:
        if DELETE + behind[state] == costs[state]:
            return letters + "D", state
        to = _NEXT[state]
        if INSERT + costs[to] == costs[state]:
            letters, state = letters + "I", to
            continue
        kept = _STEP.get((state, code & 3))
        if kept is not None and (TRUNCATED if code & _CUT else 0) + behind[kept] == costs[state]:
            return letters + "K", kept
        return letters + "R", to


def _last_edits(state: int) -> str:
    """Inserts behind the last row."""
    return {_SYSTEM: "II", _USER: "I"}.get(state, "")


def run(codes: bytes, behind: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The vector before the rows, its least taken off, and what was taken off on the way."""
    total = 0
    for code in reversed(codes):
        behind, least = _back(code, behind)
        total += least
    return behind, total


def run_again(codes: bytes, used, behind, out, total: int) -> tuple[tuple[int, ...], int]:
    """``run(codes, behind)``, given that ``run(codes, used)`` is (out, total): stops where both vectors agree."""
    less = 0
    for code in reversed(codes):
        if used == behind:
            return out, total + less
        (used, a), (behind, b) = _back(code, used), _back(code, behind)
        less += b - a
    return behind, total + less


def trace(codes: bytes, behind: tuple[int, ...], state: int) -> tuple[str, int]:
    """The edits of the rows from ``state`` on, and the state that they lead to."""
    vectors = []
    for code in reversed(codes):
        vectors.append(behind)
        behind, _ = _back(code, behind)
    letters = []
    for code, vector in zip(codes, reversed(vectors)):
        some, state = _edits(code, vector, state)
        letters.append(some)
    return "".join(letters), state


def repaired(letters: str, roles: list[str], texts: list[str], state: int) -> tuple[list[str], int]:
    """The ``role:text`` lines that the edits make of the rows."""
    out, row = [], 0
    for letter in letters:
        if letter == "I":
            out.append(f"{_ROLE[state]}:")
            state = _NEXT[state]
            continue
        if letter == "K":
            out.append(f"{roles[row]}:{texts[row]}")
            state = _STEP[state, _INITIAL[roles[row][0]]]
        elif letter == "R":
            out.append(f"{_ROLE[state]}:{texts[row]}")
            state = _NEXT[state]
        row += 1
    return out, state


class _Faults:
    """Counts over rows in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.initial = None

    def codes(self, roles, texts, is_first) -> bytes:
        """Codes of rows; ``is_first(i, role, text)`` tells whether no earlier row has this role and text."""
        out = bytearray()
        for i, (role, text) in enumerate(zip(roles, texts)):
            initial = _INITIAL.get(role[:1], 3)
            if self.initial is not None and (self.initial, initial) not in _LEGAL:
                self.illegal += 1
            self.initial = initial
            stripped, first = text.rstrip(SPACES), is_first(i, role, text)
            if not stripped:
                self.blank += 1
                out.append(initial | _GOES)
            elif not first:
                self.duplicate += 1
                out.append(initial | _GOES)
            elif stripped[-1] not in ".!?":
                self.truncated += 1
                out.append(initial | _CUT)
            else:
                out.append(initial)
        return bytes(out)

    def see(self, turns) -> None:
        """``turns`` in order; they may go on from earlier ones."""
        for turn in turns:
            if turn is not None and turn != self.most:
                self.turns += 1
                self.least, self.most = turn if self.least is None else self.least, turn

    def row(self, conv_id, cost, audit, digest) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest


RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
                      + [T.StructField(n, T.StringType()) for n in ("audit", "repaired_sha256")])
_RESULT_ARROW = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in RESULT])
_BLOCKS = "conv_id long, at long, begins boolean, ends boolean, turns array<long>, roles array<string>, texts array<string>"


def _result(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_RESULT_ARROW)], schema=_RESULT_ARROW)


def _blocks(batches, block_rows, block_chars):
    """Cut sorted rows (conv_id, turn, gone, role, text) into blocks."""
    at, fresh, held = TaskContext.get().partitionId() << 33, False, None

    def cut(table: pa.Table, last: bool):
        """The blocks of ``table``, except for the last one where more rows may follow; that one's rows."""
        nonlocal at, fresh
        ids = table.column("conv_id").combine_chunks()
        value, null = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
        run = np.concatenate([[0], np.cumsum((value[1:] != value[:-1]) | (null[1:] != null[:-1]))])
        begin = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
        size = np.cumsum(np.asarray(pa.compute.binary_length(table.column("text").combine_chunks())), dtype=np.int64)
        number = np.arange(len(run)) - begin[run]
        weight = size - (size - np.diff(size, prepend=0))[begin][run]
        block = np.stack([run, number // block_rows, weight // block_chars])
        starts = np.concatenate([[0], np.flatnonzero((np.diff(block) != 0).any(axis=0)) + 1])
        ends = np.append(starts[1:], len(run))
        own_begin = np.append(fresh, np.diff(run[starts]) > 0)
        own_end = np.append(np.diff(run[starts]) > 0, False)
        n = len(starts) if last else len(starts) - 1
        if n:
            whole = table.slice(0, int(ends[n - 1])).combine_chunks()
            there = np.flatnonzero(~np.asarray(whole.column("gone")))
            offsets = pa.array(np.searchsorted(there, np.append(starts[:n], ends[n - 1])).astype(np.int32))
            rows = whole.take(pa.array(there)).combine_chunks()
            lists = [pa.ListArray.from_arrays(offsets, c.chunk(0) if c.num_chunks else pa.array([], c.type)) for c in map(rows.column, ("turn", "role", "text"))]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(starts[:n])), pa.array(at + np.arange(n)), pa.array(own_begin[:n]), pa.array(own_end[:n]), *lists],
                names=["conv_id", "at", "begins", "ends", "turns", "roles", "texts"])
            at += n
        fresh = bool(own_begin[-1])
        return None if last else table.slice(int(starts[-1]))

    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            held = yield from cut(pa.concat_tables([held, table]) if held is not None else table, False)
    if held is not None:
        yield from cut(held, True)


def _solved(batches):
    """Whole conversations, one to a block."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            seen, faults = set(), _Faults()
            faults.see(r["turns"])
            codes = faults.codes(r["roles"], r["texts"], lambda _, role, text: not ((role, text) in seen or seen.add((role, text))))
            vector, cost = run(codes, END)
            letters, state = trace(codes, END, _NOTHING)
            letters += _last_edits(state)
            lines, _ = repaired(letters, r["roles"], r["texts"], _NOTHING)
            out.append(faults.row(r["conv_id"], cost + vector[_NOTHING], letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
        yield _result(out)


_CODED = "conv_id long, at long, codes binary, blank long, duplicate long, truncated long, illegal long, first int, last int"


def _coded(batches):
    """Codes and counts of blocks whose first occurrences are known."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            first, faults = set(r["firsts"] or ()), _Faults()
            codes = faults.codes(r["roles"], r["texts"], lambda i, *_: i in first)
            out.append({"conv_id": r["conv_id"], "at": r["at"], "codes": codes, "blank": faults.blank, "duplicate": faults.duplicate, "truncated": faults.truncated,
                        "illegal": faults.illegal, "first": codes[0] & 3 if codes else None, "last": faults.initial})
        yield pa.RecordBatch.from_pylist(out, pa.schema(
            [("conv_id", pa.int64()), ("at", pa.int64()), ("codes", pa.binary()), *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")),
             ("first", pa.int32()), ("last", pa.int32())]))


_VECTORS = "conv_id long, at long, used array<int>, out array<int>, total long, passes boolean"
_VECTORS_ARROW = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("used", pa.list_(pa.int32())), ("out", pa.list_(pa.int32())), ("total", pa.int64()), ("passes", pa.bool_())])


def _vectors(batches):
    """Run each block: from ``wanted``, or anew from an end where there is none yet."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            codes = r["codes"]
            if r.get("wanted"):
                behind = tuple(r["wanted"])
                vector, total = run_again(codes, tuple(r["used"]), behind, tuple(r["out"]), r["total"])
            else:
                behind = END
                vector, total = run(codes, behind)
            out.append({"conv_id": r["conv_id"], "at": r["at"], "used": behind, "out": vector, "total": total, "passes": all(c & _GOES for c in codes)})
        yield pa.RecordBatch.from_pylist(out, _VECTORS_ARROW)


def _converged(coded: DataFrame) -> DataFrame:
    """The vectors of all blocks, each run from what the block behind it gives.

    A block whose rows all must go hands on the vector that it gets, so the ones before it look behind it.
    """
    state = stored(coded.select("conv_id", "at", "codes").mapInArrow(_vectors, _VECTORS), "vectors")
    behind = Window.partitionBy("conv_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.array(*map(F.lit, END))
    while True:
        given = F.last(F.when(~F.col("passes"), F.col("out")), ignorenulls=True).over(behind)
        wanted = stored(state.withColumn("wanted", F.coalesce(given, end)), "wanted")
        again = wanted.where("wanted != used")
        if again.isEmpty():
            return state
        again = again.join(coded.select("at", "codes"), "at").mapInArrow(_vectors, _VECTORS)
        state = stored(wanted.where("wanted = used").drop("wanted").unionByName(again), "vectors")


def _traced(batches):
    """The edits of each block from each state, and the states that they lead to."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            found = [trace(r["codes"], tuple(r["used"]), state) for state in range(4)]
            out.append({"at": r["at"], "letters": [x for x, _ in found], "to": [s for _, s in found]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("at", pa.int64()), ("letters", pa.list_(pa.string())), ("to", pa.list_(pa.int32()))]))


def _stitched(batches):
    """Conversations from their blocks in order: only the counts, the edits and the running hash are held."""
    class Open:
        def __init__(self, conv_id, vector):
            self.conv_id, self.faults, self.letters, self.state = conv_id, _Faults(), [], _NOTHING
            self.hash, self.some, self.cost, self.last = hashlib.sha256(), False, vector[_NOTHING], None

        def add(self, lines):
            if lines:
                self.hash.update((("\n" if self.some else "") + "\n".join(lines)).encode())
                self.some = True

        def result(self):
            letters = _last_edits(self.state)
            self.add(repaired(letters, [], [], self.state)[0])
            return self.faults.row(self.conv_id, self.cost, "".join(self.letters) + letters, self.hash.hexdigest())

    now = None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now is None or now.conv_id != r["conv_id"]:
                if now:
                    out.append(now.result())
                now = Open(r["conv_id"], r["out"])
            f = now.faults
            f.see(r["turns"])
            for name in ("blank", "duplicate", "truncated", "illegal"):
                setattr(f, name, getattr(f, name) + r[name])
            if r["first"] is not None:
                f.illegal += now.last is not None and (now.last, r["first"]) not in _LEGAL
                now.last = r["last"]
            now.cost += r["total"]
            letters = r["letters"][now.state]
            lines, state = repaired(letters, r["roles"], r["texts"], now.state)
            assert state == r["to"][now.state]
            now.letters.append(letters)
            now.add(lines)
            now.state = state
        if out:
            yield _result(out)
    if now:
        yield _result([now.result()])


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           gone: str | None = None, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for each conversation.

    Rows count in order of turn, null first; rows of one turn in order of the first 32 characters of role and text,
    then of a hash of both. A row's first fault counts: blank (nothing but ASCII white space), duplicate (its role
    and text stood earlier), truncated (its last other character is none of ``.!?``). Edits: K keep, R change the
    role to user or assistant (2), D delete (3), I insert a user or assistant row without text (2); blank and
    duplicate rows must go, a truncated one that stays costs 1. ``audit`` has the cheapest edits, the least in ASCII
    order among equals; the hash is that of the remaining ``role:text`` lines. ``gaps`` counts turns missing between
    the least and the greatest; ``illegal`` neighbours whose initials are none of su, ua, au. A role without
    characters has no initial and can't be kept.

    A null role or text is one space, a null conversation is one of its own, ``gone`` names a boolean column of rows
    that only testify that a conversation exists. Extra columns are ignored, repeated rows are duplicates, an empty
    table gives an empty result.

    Rows of a conversation of any size are dealt over blocks, also equal rows. One task reads a long conversation's
    blocks in order at the end, since a hash of all its text can't be had otherwise; it holds one block at a time.
    """
    none = F.lit(False) if gone is None else F.coalesce(F.col(gone), F.lit(False))
    own = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), none.alias("gone"),
                      F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    own = own.withColumns({"role": F.when(~F.col("gone"), F.col("role")).otherwise(""), "text": F.when(~F.col("gone"), F.col("text")).otherwise(""),
                           "id": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 32), F.xxhash64("role", "text"), "id"]
    rows = own.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "gone", "role", "text")
    blocks = stored(rows.mapInArrow(lambda batches: _blocks(batches, block_rows, block_chars), _BLOCKS), "conversation_blocks")
    solved = blocks.where("begins AND ends").mapInArrow(_solved, RESULT)

    rest = blocks.where("NOT (begins AND ends)")
    said = rest.select("conv_id", "at", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "said"))
    said = said.select("conv_id", "at", "place", F.sha2(F.concat(F.char_length("said.roles").cast("string"), F.lit(":"), "said.roles", "said.texts"), 256).alias("said"))
    firsts = said.groupBy("conv_id", "said").agg(F.min(F.struct("at", "place")).alias("first"))
    firsts = firsts.groupBy("first.at").agg(F.collect_list("first.place").alias("firsts"))
    coded = stored(rest.join(firsts, "at", "left").select("conv_id", "at", "roles", "texts", "firsts").mapInArrow(_coded, _CODED), "coded_blocks")
    vectors = _converged(coded)
    letters = coded.select("at", "codes").join(vectors.select("at", "used"), "at").mapInArrow(_traced, "at long, letters array<string>, to array<int>")
    counts = coded.drop("codes", "conv_id").join(vectors.select("at", "out", "total"), "at").join(letters, "at")
    whole = rest.select("conv_id", "at", "turns", "roles", "texts").join(counts, "at")
    return solved.unionByName(whole.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_stitched, RESULT))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone``: rows with faults put in, told by crc32 of ``conv_id:turn`` modulo 20.

    0: gone, 1: no text, 2: no ``.!?``, 3: stands twice, 4: role user. Nulls are one space (but for the columns
    conv_id and turn themselves).
    """
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    own = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = own.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                     (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return out.select("conv_id", "turn", "role", "text", "gone", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("col")
