"""Merge-type encoding against the sentencepiece library."""

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from realpay.llm import pieces
from tests.llm.test_operators import DOCS, EXTRA, frame, ordered, rows

ODD = ["", " ", "  ", "\n", " \n a", "▁", "▁▁ a", "a\u0000b", "﻿x", "漢字かな 交じり", "🙂🙂 x", "<s> </s> <unk> <0x0A>", "a" * 5000, "\t\tx\r\n  y",
       " " * 300 + "x" + " " * 17, "é", "▁▁▁", "1234567890 " * 5, "no-space" * 40, "é"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def made(n):
    rng = random.Random(3)
    letters = "aeiounrstldmhcgp" * 6 + " " * 30 + "\n\t▁éüßñç漢🙂.,;!?0123456789<>_-" + "THEA"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(n)]


def test_ids_are_the_librarys(library):
    texts = ODD + made(1500)
    assert pieces.vocabulary().encode(texts) == library.encode(texts, num_threads=1)


def test_heap_and_matrix_agree():
    known = pieces.vocabulary()
    texts = [pieces.SPACE + x for x in made(400) if x]
    assert known._together(texts) == [known._heap(x) for x in texts]


def test_forgotten_words_are_encoded_again(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    texts = made(60)
    known = pieces.vocabulary.__wrapped__(pieces.MODEL)
    assert [known.encode([x])[0] for x in texts] == library.encode(texts, num_threads=1)
    assert len(known.remembered) <= 40


def test_whole_texts(spark, library):
    docs = frame(spark, DOCS, "doc_id long, text string", EXTRA).repartition(3)
    expected = []
    for doc_id, text in DOCS:
        ids = library.encode(text or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        expected.append((doc_id, len(ids), *sha))
    assert rows(pieces.digests(pieces.encode(docs)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ordered(expected)
    assert pieces.differing(docs).count() == 0
    assert pieces.encode(docs.limit(0)).count() == 0


def test_given_texts_are_the_librarys(spark):
    assert pieces.differing(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).count() == 0


def test_other_models_are_refused(tmp_path):
    # a model of one piece, of type unigram (1), with an identity normaliser
    path = tmp_path / "other.model"
    path.write_bytes(b"\x0a\x03\x0a\x01a" + b"\x12\x02\x18\x01" + b"\x1a\x02\x20\x00")
    with pytest.raises(ValueError, match="not a merge-type"):
        pieces.vocabulary(str(path))
