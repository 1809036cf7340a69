"""Conversation repair against a search over all edits."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from realpay.llm import conversations
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string"
ROLES = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "u"]
TEXTS = [f"t{i}." for i in range(40)] + ["", "  \n", None, "no end", "Why? ", "x!"]


def key(row):
    return row[0] is not None, row[0] or 0


def plain(rows):
    by = defaultdict(list)
    for conv_id, *row in rows:
        by[conv_id].append(tuple(row))
    return sorted((brute.conversation(*x) for x in by.items()), key=key)


def repair(spark, rows, **sizes):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("codes", "at", "id")}).repartition(3)
    return sorted(map(tuple, conversations.repair(conversations.damaged(df), gone="gone", **sizes).collect()), key=key)


def made(n, convs, seed=5):
    r = random.Random(seed)
    return [(r.choice(convs), r.choice([None, *range(-2, 14)]), r.choice(ROLES), r.choice(TEXTS)) for _ in range(n)]


@pytest.mark.parametrize("block", [4096, 3])
def test_many_conversations(spark, block):
    rows = made(1500, [None, *range(150)])
    assert repair(spark, rows, block_rows=block) == plain(rows)


def test_one_conversation_over_many_blocks(spark):
    rows = [(7 if i % 3 else 100 + i % 5, i // 2 if i % 9 else None, ("user", "assistant")[i % 2] if i % 7 else "system",
             f"text {i % 50 if i % 5 else i}." if i % 11 else "cut") for i in range(1200)]
    assert repair(spark, rows, block_rows=7) == plain(rows)


def test_long_texts_are_blocks_of_their_own(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], "long text " * (300 if i % 3 else 1) + f"{i}.") for i in range(60)]
    assert repair(spark, rows, block_chars=500) == plain(rows)


def test_blocks_of_copies_hand_vectors_on(spark):
    rows = [(1, i, "user", "same.") for i in range(500)] + [(1, i + 500, "assistant" if i % 4 else "user", f"s{i}.") for i in range(300)]
    rows += [(1, 3, "user", "same.")] * 200
    assert repair(spark, rows, block_rows=20) == plain(rows)


def test_no_rows_left_and_empty_table(spark):
    gone = next(i for i in range(1000) if brute.zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repair(spark, [(gone, 0, "user", "Hello.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", brute.hashlib.sha256(b"").hexdigest())]
    assert repair(spark, []) == []


def test_run_again_stops_where_vectors_agree():
    r = random.Random(2)
    codes = bytes(r.choice((0, 1, 2, 3, 5, 9, 10)) for _ in range(300))
    for behind in ((0, 4, 2, 0), (5, 0, 1, 3), (0, 0, 0, 0)):
        out, total = conversations.run(codes, conversations.END)
        assert conversations.run_again(codes, conversations.END, behind, out, total) == conversations.run(codes, behind)


def test_undamaged_rows_by_default(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Yes."), (2, 2, "system", "Be brief")]
    out = sorted(map(tuple, conversations.repair(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert out == [brute.repaired(1, [r[1:] for r in rows[:2]]), brute.repaired(2, [r[1:] for r in rows[2:]])]
    assert out[0][-2] == "KK" and out[1][1] == 1
