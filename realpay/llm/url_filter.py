"""Web addresses allowed or blocked by rules and, where no rule fits, by a learned model.

The model is a logistic regression on hashed character n-grams of host and path. It is trained on a small
table of labelled addresses.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from realpay.llm import urls
from realpay.llm.textbytes import column_bytes, prefix_sums, range_hashes

GRAMS = (3, 4, 5)
BUCKETS = 1 << 16
#: Labelled addresses that the model is trained on, at most: those with the least hashes.
TRAINING_ROWS = 20_000
EPOCHS, STEP, DECAY = 200, 0.5, 1e-5


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def first_rule(host, path, rules=RULES):
    """The longest rule that fits, as a struct of its text and verdict, or null."""
    out = F.lit(None)
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def _buckets(columns: list) -> tuple[np.ndarray, np.ndarray]:
    """The row and the bucket of every n-gram of every column."""
    rows, buckets = [], []
    for salt, column in enumerate(columns):
        data, offsets = column_bytes(column)
        sums = prefix_sums(data)
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes to the end of the row
        row = np.repeat(np.arange(len(column)), np.diff(offsets))
        for n in GRAMS:
            at = np.flatnonzero(left >= n)
            rows.append(row[at])
            buckets.append(((range_hashes(sums, at, at + n) + np.uint64(salt)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def _framed(host, path):
    return F.concat(F.lit("^"), host, F.lit("$")), F.concat(path, F.lit("$"))


class Model(NamedTuple):
    weights: np.ndarray
    bias: float

    def scores(self, columns: list) -> np.ndarray:
        """The probability that an address is to be blocked."""
        rows, buckets = _buckets(columns)
        n = len(columns[0])
        size = np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
        return 1 / (1 + np.exp(-(np.bincount(rows, self.weights[buckets], minlength=n) / size + self.bias)))


def train(labelled: DataFrame, rows: int = TRAINING_ROWS) -> Model | None:
    """Fit on ``host, path, blocked``, each class weighted alike; None if a class has no address.

    Of more than ``rows`` different addresses those with the least hashes are taken, so repeats of an address
    add no weight and the sample is the same in every run.
    """
    host, path = _framed(F.col("host"), F.col("path"))
    sample = labelled.select(host.alias("host"), path.alias("path"), "blocked").distinct()
    sample = sample.orderBy(F.xxhash64("host", "path"), "host", "path", "blocked").limit(rows).toArrow().combine_chunks()
    y = sample["blocked"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    row, bucket = _buckets([sample[c].combine_chunks() for c in ("host", "path")])
    size = np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    class_weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    weights, bias, squares = np.zeros(BUCKETS), 0.0, np.full(BUCKETS + 1, 1e-8)
    for _ in range(EPOCHS):  # AdaGrad on all rows
        p = 1 / (1 + np.exp(-(np.bincount(row, weights[bucket], minlength=len(y)) / size + bias)))
        off = (p - y) * class_weight
        slope = np.append(np.bincount(bucket, (off / size)[row], minlength=BUCKETS) + DECAY * weights, off.sum())
        squares += slope**2
        step = STEP * slope / np.sqrt(squares)
        weights, bias = weights - step[:-1], bias - step[-1]
    return Model(weights, float(bias))


def labelled_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """``host, path, blocked`` of the addresses that a rule decides: a labelled table where no other is given."""
    parts = pages.select(urls.host("url").alias("host"), urls.path("url").alias("path"))
    found = parts.withColumn("r", first_rule(F.col("host"), F.col("path"), rules)).where("r is not null")
    return found.select("host", "path", (F.col("r.verdict") == "block").alias("blocked"))


def judged(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_probability`` for each row of ``pages`` (``page_id, url``).

    ``rules`` is a short list; of those that fit, the longest decides and ``rule`` is its text, else null and
    the model decides, at a probability of one half. ``labelled`` (``host, path, blocked``) trains it; without
    it the addresses that a rule decides do. If a class has no labelled address, there is no model, the
    probability is null and what no rule decides is allowed. A url that is null or has no :// has an empty host
    and path and is judged like any other. Repeated rows are judged each; other columns are ignored.
    """
    model = train(labelled_by_rules(pages, rules) if labelled is None else labelled)
    rows = pages.select("page_id", urls.host("url").alias("host"), urls.path("url").alias("path"))
    framed = rows.select("*", *(x.alias(n) for x, n in zip(_framed(F.col("host"), F.col("path")), ("framed_host", "framed_path"))))
    if model is None:
        scored = rows.withColumn("block_probability", F.lit(None).cast("double"))
    else:
        sent = pages.sparkSession.sparkContext.broadcast(model)

        def score(batches):
            for batch in batches:
                p = sent.value.scores([batch.column("framed_host"), batch.column("framed_path")])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p)], names=["page_id", "host", "path", "block_probability"])

        scored = framed.mapInArrow(score, T.StructType([*rows.schema.fields, T.StructField("block_probability", T.DoubleType())]))
    scored = scored.withColumn("r", first_rule(F.col("host"), F.col("path"), rules))
    learned = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", learned).alias("verdict"), "block_probability")
