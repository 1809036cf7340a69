"""The pipeline on the smallest table, against plain versions of its stages, and on an empty and an odd table."""

import numpy as np
import pytest

import corpus_pipeline
from realpay.llm import packing, quality
from tests.conftest import SF001
from tests.llm import brute


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    keep = {r["doc_id"] for r in quality.judged(docs, spark.read.parquet(f"{SF001}/labels.parquet")).where("keep").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in keep]
    texts = dict(rows)
    rows = [(d, texts[d]) for d, _, c in brute.near_copies(rows) if d == c]
    items = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(d, t) for d, t in rows if not brute.contaminated(t, items)[4]]
    want = {}
    for d, t in rows:
        out, done = [], 0
        for kind, start, end in sorted(brute.personal(t), key=lambda s: (s[1], s[2])):
            if start >= done:
                out += [t[done:start], f"[{kind.upper()}]"]
            done = max(done, end)
        want[d] = len(packing.token_ids("".join(out) + t[done:])) + 1
    found = corpus_pipeline.run(spark, SF001).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in found} == want
    assert sum(r["length"] for r in found) == sum(want.values())


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stage_takes_empty_and_odd_tables(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, threshold string, row string, size string, fp string"
    odd = [(None, None, None, None, None, "", "", "", "", ""), (1, "", "en", "s", 0, "", "", "", "", ""), (2, "x " * 200_000, "en", "s", 5, "", "", "", "", ""),
           (3, "A clean line of words that says little.", None, None, None, "", "", "", "", ""), (3, "A clean line of words that says little.", None, None, None, "", "", "", "", "")]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        out = stage(spark, docs, SF001)
        assert out.count() >= (1 if rows else 0)
        if stage is not corpus_pipeline.pack:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
            assert out.count() <= len(rows)


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "pii", "packing"]
    assert np.all([callable(f) for _, f in corpus_pipeline.STAGES])
