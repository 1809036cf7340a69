"""Each operator against its plain version, on texts with nulls, empties, long texts, ties, repeated rows,
empty tables and extra columns whose names clash with those used inside."""

import gzip
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from realpay.llm import ctw, decontaminate, packing, pii, quality, simhash, suffix_dedup, topk, url_filter, warc
from realpay.llm.tables import new_path
from tests.llm import brute

LONG = " ".join(f"w{i * 7919 % 4001} number {i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
DOCS = [
    (1, f"Intro one. {PASSAGE} tail one"), (2, f"other intro {PASSAGE} and its own tail"), (3, None), (4, ""), (5, " \t\n "), (6, "a"), (7, "A"),
    (8, "é" * 300), (9, "x" * 500), (10, LONG), (11, LONG[1000:400_000]), (12, "Write to jo.do@mail.example.com or 10.0.0.255, card 4539 1488 0343 6467."),
    (13, "call +1 (372) 555-7739 now"), (13, "call +1 (372) 555-7739 now"), (14, f"{PASSAGE} {PASSAGE}"), (15, "x" * 99), (16, "<|endoftext|> zero\x00byte ünï 漢字 🙂"),
    (None, f"no id {PASSAGE}"), (None, None), (17, "word " * 400), (18, "one two three four five six seven eight nine ten eleven"), (-5, "negative one two three"),
]
EXTRA = ["id", "key", "row", "fp", "size", "bits", "spans", "found", "threshold", "place", "label", "c"]
ITEMS = [(1, " ".join(PASSAGE.split()[5:30])), (2, "three four"), (3, None), (4, "..."), (5, "One, two! THREE four five six seven eight nine ten"), (5, "negative one"),
         (None, "write to"), (6, "")]


def frame(spark, rows, schema, extra=()):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, DOCS, "doc_id long, text string", EXTRA).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=lambda r: tuple((x is None, x) for x in r))


def ordered(values):
    return sorted(values, key=lambda r: tuple((x is None, x) for x in r))


# -- 1


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(3)
    for n, kinds in ((0, 1), (1, 1), (700, 1), (2000, 2), (2000, 256)):
        text = rng.integers(0, kinds, n).astype(np.uint8)
        data, order = text.tobytes(), suffix_dedup.suffix_array(text)
        assert sorted(order.tolist()) == list(range(n))
        heads = [data[i : i + 100].ljust(100, b"\0") for i in order]
        assert heads == sorted(heads)
        common = suffix_dedup.common_prefixes(text, order)
        for x, y, c in list(zip(heads, heads[1:], common))[::11]:
            assert c == next((k for k in range(100) if x[k] != y[k]), 100)


def test_repeated_passages(spark, docs):
    found = rows(suffix_dedup.without_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    order = sorted(DOCS, key=lambda d: (d[0] is None, d[0] or 0, d[1] is not None, d[1] or ""))
    assert found == ordered(brute.repeats(order))


def test_repeated_passages_keeps_bytes(spark):
    own = [(1, "ab" * 80), (2, "z" + "ab" * 70)]
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.without_repeats(frame(spark, own, "doc_id long, text string"), with_kept=True).collect()}
    # the first 100 bytes of each kind of window stand once in document 1: only its first 2 windows are new
    assert kept == {1: b"ab", 2: b"z"}
    assert [hashlib.sha256(kept[i]).hexdigest() for i in (1, 2)] == [r[4] for r in brute.repeats(own)]


LINE = "one line of ninety bytes that stands in every document of the corpus, between other words."


@pytest.mark.parametrize("bounds", [(0, 1 << 20, 1 << 19, 256), (0, 400, 200, 0), (2, 3000, 900, 1), (1 << 30, 2000, 500, 256)])
def test_repeated_passages_with_hot_lines(spark, bounds):
    """Runs cut at once, keys cut again down to single windows, salted anchors: the same rows in every way."""
    rng = np.random.default_rng(11)
    around = ["".join(rng.choice(list("abcdefgh "), 60)) for _ in range(9)]
    own = [(i, f"{around[i % 9]}{i % 7}{LINE}{i % 5}{around[i % 4]} {i % 3} {PASSAGE[: 40 * (i % 6)]}") for i in range(150)]
    own += [(150, None), (151, ""), (152, LINE * 4), (153, "a" * 500), (154, "a" * 700)]
    found = suffix_dedup.without_repeats(frame(spark, own, "doc_id long, text string"), bounds=suffix_dedup.Bounds(*bounds))
    assert rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == ordered(brute.repeats(own))


def test_a_hot_line_does_not_fill_a_task():
    """One line of 90 bytes in 30,000 different contexts: no array grows with their number."""
    import tracemalloc

    bounds, rng = suffix_dedup.Bounds(), np.random.default_rng(5)
    front, back = (rng.integers(97, 123, (30_000, 30), np.uint8) for _ in range(2))
    cut = [part for i in range(30_000) for part in suffix_dedup._cut_pieces(
        suffix_dedup.Piece(0, 7, i, 0, 55, front[i].tobytes() + LINE.encode() + back[i].tobytes()), 16)]
    names = suffix_dedup._PIECE.names
    for finer in (4, 1, None):
        cut.sort()
        held = [suffix_dedup.pa.RecordBatch.from_pylist([dict(zip(names, p)) for p in cut[k : k + 10_000]], suffix_dedup._FOUND) for k in range(0, len(cut), 10_000)]
        tracemalloc.start()
        spans, cut, peak = 0, [], 0
        for out in suffix_dedup._array_spans(held, bounds):
            peak = max(peak, tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            found = out.to_pylist()
            spans += sum(r["end"] is not None for r in found)
            cut += [suffix_dedup.Piece(*(r[n] for n in names)) for r in found if r["end"] is None]
            tracemalloc.start()
        tracemalloc.stop()
        assert peak < 200 << 20
        assert all(p.cut == finer for p in cut)
        if not cut:
            break


# -- 2


def test_decontamination(spark, docs):
    items = frame(spark, ITEMS, "item_id long, text string", ["id", "passage"])
    found = rows(decontaminate.contamination(docs, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found == ordered([(d, *brute.contaminated(t, ITEMS)) for d, t in DOCS])
    kept = rows(decontaminate.clean(docs, items), "doc_id", "text")
    assert kept == ordered([(d, t) for d, t in DOCS if not brute.contaminated(t, ITEMS)[4]])


@pytest.mark.parametrize("pairs", [0, 1, 32])
def test_decontamination_of_frequent_fingerprints(spark, pairs):
    """A k-gram in many surroundings, paired or joined by windows: the same rows."""
    rng = np.random.default_rng(2)
    some = [f"w{i}" for i in range(6)]
    common = "the same five words again".split()
    texts = [" ".join([*rng.choice(some, 7), *common, *rng.choice(some, 7), *common[: i % 5]]) for i in range(60)]
    items = [(i, " ".join(t.split()[i % 4 : 12 + i % 7])) for i, t in enumerate(texts[:40])] + [(90, "a a a a a a a a a a a"), (91, "w1 w2"), (None, texts[41])]
    own = [(i, f"{t} {texts[-i]}") for i, t in enumerate(texts)] + [(70, "a " * 40), (71, None)]
    found = decontaminate.contamination(frame(spark, own, "doc_id long, text string"), frame(spark, items, "item_id long, text string"), pairs=pairs)
    wanted = [(i, *brute.contaminated(t, items)) for i, t in own]
    assert rows(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == ordered(wanted)


def test_decontamination_with_an_empty_side(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).where("contaminated").count() == 0
    assert decontaminate.contamination(no_docs, frame(spark, ITEMS, "item_id long, text string")).count() == 0
    assert decontaminate.clean(docs, none).columns == docs.columns


# -- 3

URLS = [(1, "http://a.example.net/en/x"), (2, "HTTPS://WWW.Example.NET/en"), (3, "ftp://net/?q"), (4, "http://x.net"), (5, "http://example.com/de/1#a"), (6, "no scheme/net/"), (7, None),
        (8, ""), (9, "http://a.org/fr/z?://net/"), (10, "http://notexample.net/en/"), (11, "x://y\nz.net/a\nb?"), (11, "x://y\nz.net/a\nb?"), (None, "http://q.com/" + "p" * 50_000), (12, "http://org/fr/")]


def test_url_rules(spark):
    pages = frame(spark, URLS, "page_id long, url string", ["host", "path", "rule", "r"])
    found = url_filter.judged(pages).collect()
    for row, (page_id, url) in zip(sorted(found, key=lambda r: (r["page_id"] is None, r["page_id"])), URLS[:12] + URLS[13:] + URLS[12:13]):
        host, path, rule, verdict = brute.verdict(url, url_filter.RULES)
        assert (row["page_id"], row["host"], row["path"], row["rule"]) == (page_id, host, path, rule)
        assert row["verdict"] == verdict if rule else row["verdict"] in ("allow", "block")


def test_url_model_learns_and_needs_both_classes(spark):
    labelled = spark.createDataFrame([(f"{'spam' if i % 2 else 'good'}{i}.test", f"/p{i}", bool(i % 2)) for i in range(400)], "host string, path string, blocked boolean")
    pages = spark.createDataFrame([(i, f"http://{'spam' if i % 2 else 'good'}{i}.test/q{i}") for i in range(1000, 1100)], "page_id long, url string")
    right = url_filter.judged(pages, labelled).where("verdict = if(page_id % 2 = 1, 'block', 'allow')").count()
    assert right >= 98
    one = url_filter.judged(pages, labelled.where("blocked"))
    assert one.where("verdict = 'allow' and block_probability is null").count() == 100
    assert url_filter.judged(pages.limit(0)).count() == 0


# -- 4


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_covering_masks_miss_no_pair(radius):
    import itertools

    for bits in itertools.combinations(range(0, 64, 5 if radius == 3 else 3), radius):
        assert any(all(not m >> b & 1 for b in bits) for m in simhash.masks(radius))


def test_near_copies(spark, docs):
    assert rows(simhash.near_copies(docs), "doc_id", "fingerprint", "component_id") == ordered(brute.near_copies(DOCS))


def test_large_buckets_lose_no_link(spark):
    rng = np.random.default_rng(1)
    prints = {0, *(1 << int(b) for b in range(20))} | {int(a) ^ 1 << int(b) for a, b in zip(rng.integers(0, 2**63, 50), rng.integers(0, 60, 50))}
    prints = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    table = F.explode(F.sequence(F.lit(0), F.lit(6)))
    edges = simhash._large_buckets(df.select("fp", table.alias("t")), 2).collect()
    assert all(((e["u"] ^ e["v"]) & (1 << 64) - 1).bit_count() <= 4 for e in edges)
    group = {x: x for x in prints}
    for _ in prints:
        for e in edges:
            group[e["u"]] = group[e["v"]] = min(group[e["u"]], group[e["v"]])
    for a in prints:
        for b in prints:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                assert group[a] == group[b]


def test_keep_one(spark, docs, no_docs):
    kept = rows(simhash.keep_one(docs), "doc_id", "text")
    want = {d for d, _, c in brute.near_copies(DOCS) if d is not None and d == c}
    assert [d for d, _ in kept if d is not None] == sorted(want) and sum(d is None for d, _ in kept) == 2
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_copies(no_docs).count() == 0


# -- 5


def test_personal_data(spark, docs):
    own = [(100 + i, t) for i, t in enumerate([
        "a@b.c@d.e a@b@c.d x..@y.z-.w @q.r", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.004 1.2.3", "4539148803436467 4539-1488-0343-6467 4539  148803436467 12345678901234567890",
        "+1234567 +12345678 +1 2 3 4 5 6 7 8) + 12345678 +1(2)3.4-5 6789012345678", "+" * 50 + "1 2345678", "9" * 5000, "a" * 5000 + "@b.c", "é 1.1.1.1 漢 z@y.xx"])]
    found = personal = rows(pii.personal_data(docs.select("doc_id", "text").unionByName(frame(spark, own, "doc_id long, text string"))), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = []
    for d, t in DOCS + own:
        spans = brute.personal(t)
        counts = [sum(k == kind for k, _, _ in spans) for kind in pii.KINDS]
        want.append((d, *counts, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()))
    assert found == personal == ordered(want)


def test_patterns_discover_what_has_no_fixed_form(spark):
    seeds = [(i, f"some text {i}; my phone number +1 555 01{i:02d} 99{i:02d} is new, so is w{i}") for i in range(30)]
    unseen = [(100, "she said my phone number 555-0137-2234 is new to her"), (101, "part 555-0137-9999 of the order 12 is late"), (102, "no digits in my phone number here is new")]
    found = {r["doc_id"]: r["spans"] for r in pii.personal_data(frame(spark, seeds + unseen, "doc_id long, text string")).collect()}
    start = unseen[0][1].index("555")
    assert found[100] == f"phone:{start}:{start + 13}" and found[101] == "" and found[102] == ""


def test_redaction(spark, docs, no_docs):
    out = dict(rows(pii.redact(docs).where("doc_id is not null"), "doc_id", "text"))
    assert out[12] == "Write to [EMAIL] or [IP], card [CARD]." and out[13] == "call [PHONE] now" and out[3] is None and out[10] == LONG
    assert pii.redact(docs).count() == len(DOCS) and pii.redact(docs).columns == docs.columns
    assert pii.redact(no_docs).count() == 0
    sized = pii.redact(frame(spark, [(1, "a@b.c", 5)], "doc_id long, text string, n_chars int")).collect()
    assert [tuple(r) for r in sized] == [(1, "[EMAIL]", 7)]


# -- 6


def symbols(text):
    return [int(c) for c in quality._CLASS[np.frombuffer(text.encode(), np.uint8)] if c != quality.DROPPED]


def test_model_is_kneser_ney(spark):
    texts = ["The cat sat on the mat.", "The dog, 12 of them; été!", "aaaa bbbb the cat", ""]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert np.allclose((2.0 ** model.astype(float)).reshape(-1, 32).sum(axis=1), 1, atol=1e-4)
    p = brute.kneser_ney(texts, quality.ORDER, quality.CLASSES, symbols)
    for text in ("The cat ate", "zz Z9"):
        s = [quality.SPACE] * 3 + symbols(text)
        grams, _ = quality.grams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        assert np.allclose(model[grams], [np.log2(p(tuple(s[i : i + 4]))) for i in range(len(s) - 3)], atol=1e-4)


def test_quality_keeps_good_text(spark, no_docs):
    rng = np.random.default_rng(0)
    vocabulary = "the of and to in that was with this from house river stone winter letter walk".split()
    good = [(i, " ".join(rng.choice(vocabulary, 60)).capitalize() + ".", "en" if i % 3 else None) for i in range(300)]
    bad = [(1000 + i, "".join(rng.choice(list("#$%&*XQZ019|"), 300)), "en") for i in range(30)]
    edge = [(2000, None, "en"), (2001, "", "xx"), (None, good[0][1], "xx"), (5, good[5][1], "en")]
    df = frame(spark, good + bad + edge, "doc_id long, text string, lang string", ["threshold", "size", "bits", "quality"])
    labels = frame(spark, [(i, 1, 0) for i in range(250)] + [(1000 + i, 0, 0) for i in range(20)] + [(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.judged(df, labels).collect()
    keep = [(r["doc_id"], r["keep"]) for r in out]
    assert len(keep) == len(good + bad + edge)
    assert sum(k for d, k in keep if d is not None and d < 1000) >= 299 and not any(k for d, k in keep if d is not None and d >= 1000)
    assert (None, True) in keep
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(k for _, k in keep)
    assert quality.judged(no_docs, labels).count() == 0
    assert quality.judged(df, labels.limit(0)).where("keep").count() == len(good + bad) + 2


# -- 7

PAGES = [(3, "http://B.example.org/x?q", "same" * 50), (1, "http://a.example.org/y", "same" * 50), (2, None, "short"), (4, "no url\r\nhere", "short"), (5, "http://a.example.org/y", None),
         (6, "http://z.org/", ""), (7, "http://a.example.org/Y", "breaks\r\n\r\ninside " * 20), (8, "http://b.example.org/x", "é漢" * 100), (1, "http://a.example.org/y", "same" * 50),
         (None, "http://a.example.org/y", "same" * 50), (9, "http://a.example.org/y", "L" * 2_000_000), (10, "http://z.org/", "L" * 2_000_000)]


def test_archives_come_back(spark):
    pages = frame(spark, PAGES, "page_id long, url string, html string", ["digest", "size", "first", "file"])
    path = new_path(spark, "warc-test")
    warc.write_archives(pages, path)
    back = warc.read_archives(spark, path).collect()
    html = {p: h or "" for p, _, h in PAGES}
    assert len(back) == len(PAGES)
    assert all(bytes(r["payload"]).decode() == html[r["page_id"]] for r in back if r["record_type"] == "response" and r["page_id"])
    out = rows(warc.archive_round_trip(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for page, _, h in PAGES:
        data = (h or "").encode()
        first = min((p for p, _, o in PAGES if p is not None and (o or "") == (h or "")), default=None)
        again = len(data) >= 100 and page is not None and page != first
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert out == ordered(want)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_index_is_in_global_order(spark):
    pages = spark.createDataFrame([(i, f"http://h{i * 7 % 11}.test/p{i % 5}", f"<p>{i}") for i in range(500)], "page_id long, url string, html string").repartition(6)
    path = new_path(spark, "warc-test")
    warc.write_archives(pages, path)
    entries = [(r["urlkey"], r["captured"], r["page_id"]) for r in warc.index(warc.read_archives(spark, path, False)).collect()]
    assert len(entries) == 500 and entries == sorted(entries)


def test_long_records_come_back_in_pieces(spark):
    pages = spark.createDataFrame([(i, "http://a.test/", "\n".join(["WARC/1.1\r", "\r", "x" * i] * 4_000)) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    path = new_path(spark, "warc-test")
    warc.write_archives(pages, path)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)  # a record is many batches
    try:
        back = warc.read_archives(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in back} == {r["page_id"]: r["html"] for r in pages.collect()}
    assert sorted(r["position"] for r in back) == np.cumsum([0] + [r["record_bytes"] for r in sorted(back, key=lambda r: r["position"])])[:-1].tolist()


def test_archives_are_read_from_pieces_of_any_length():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\na\r\n\r\nb\n\nc\r\n\r\n"
    for size in (1, 2, 7, len(record), 1000):
        data = record * 5
        pieces = [("f", data[i : i + size]) for i in range(0, len(data), size)] + [("g", record)]
        assert [(f, o, b) for f, o, _, _, b in warc._records(pieces)] == [("f", i * len(record), b"a\r\n\r\nb\n\nc") for i in range(5)] + [("g", 0, b"a\r\n\r\nb\n\nc")]
    with pytest.raises(ValueError):
        list(warc._records([("f", record[:-1]), ("g", record)]))


def test_pieces_of_runs_are_merged():
    rng = np.random.default_rng(3)
    entries = [(f"k{rng.integers(20)}", "2024", None if rng.random() < 0.1 else int(rng.integers(9)), f"f{i % 3}", i, 1, "response", None, 1, "d") for i in range(3_000)]
    key = lambda e: (e[0], e[1], e[2] is not None, e[2] or 0, e[3], e[4])
    types = ["string", "string", "int64", "string", "int64", "int64", "string", "int64", "int64", "string"]
    batches = []
    for low in range(0, 3_000, 70):
        piece = sorted(entries[low : low + 70], key=key)
        batches.append(pa.RecordBatch.from_arrays([pa.array([e[i] for e in piece], getattr(pa, t)()) for i, t in enumerate(types)], names=warc._ENTRY))
    merged = [tuple(r.values()) for batch in warc._merge(iter(batches)) for r in batch.to_pylist()]
    assert merged == sorted(entries, key=key) and list(warc._merge(iter([]))) == []


def test_loser_tree_merges():
    rng = np.random.default_rng(0)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted((int(x), 0) for x in rng.integers(0, 50, rng.integers(0, 30))) for _ in range(k)]
        merged = list(warc.LoserTree([[(key, key) for key in run] for run in runs]))
        assert merged == sorted(key for run in runs for key in run)


def test_damaged_archive_is_refused():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [(o, n, b) for o, n, _, b in warc.parse(record * 2)] == [(0, len(record), b"abc"), (len(record), len(record), b"abc")]
    with pytest.raises(ValueError):
        list(warc.parse(record[:-3] + b"xx\n"))
    assert gzip.decompress(gzip.compress(record)) == record


# -- 8


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=8).round(2).tolist()) for i in range(400)]
    vectors += [(i, vectors[7][1]) for i in range(400, 520)]  # one very common vector
    vectors += [(50_000, None), (50_050, [1.0, None] + [0.0] * 6), (50_100, [float("nan")] * 8), (50_150, [float("inf")] * 8), (50_200, []), (None, [0.5] * 8), (7, vectors[7][1]),
                (50_250, [3.0, 4.0]), (50_251, [1.0, 1.0]), (50_300, [2.0**24 + 1] * 3), (50_301, [2.0**20 + 1] * 3)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("x", T.StringType()), T.StructField("score", T.StringType())])
    df = spark.createDataFrame([(*v, "a", "b") for v in vectors], schema).repartition(4)
    want = []
    fit = [(i, [int(np.floor(c * 256)) for c in v]) for i, v in vectors if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    for q, x in fit:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in fit if i != q and len(y) == len(x))[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    for shard in (16_384, 100, 25):
        topk.SHARD_ROWS = shard
        try:
            assert rows(topk.top_k(df, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score") == sorted(want)
        finally:
            topk.SHARD_ROWS = 16_384
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# -- 9


def test_scores(spark, docs, no_docs):
    out = ctw.scores(docs).collect()
    want = [(d, *u) for (d, _), u in zip(DOCS, brute.unigram(DOCS))]
    get = lambda r: (r[0], *r[1:5], round(r[5], 6))
    assert ordered(get(r) for r in out) == ordered(get(w) for w in want)
    assert all(r["score"] < 0 and abs(r["bits_per_byte"] * r["n_bytes"] + r["score"] / np.log10(2)) < 1e-6 for r in out)
    assert ctw.scores(no_docs).count() == 0


def test_tree_equals_its_definition(spark, monkeypatch):
    """Whether all, some or none of the strings are among the common ones, and however the subtrees are dealt."""
    rows = [r for r in DOCS if r[0] not in (10, 11)] + [(i, f"the cat sat on the mat {i} times, the dog {i % 7} did not") for i in range(100, 160)]
    rows += [(9, "été the dog"), (40, "zebra quiz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((str(d), round(s, 3)) for (d, _), s in zip(rows, brute.context_tree(rows)))
    for common, subtrees, block in ((1 << 21, 1 << 16, 1 << 23), (300, 50, 600), (0, 1, 1)):
        monkeypatch.setattr(ctw, "COMMON", common)
        monkeypatch.setattr(ctw, "SUBTREES", subtrees)
        monkeypatch.setattr(ctw, "BLOCK_BYTES", block)
        found = ctw.scores(df).collect()
        assert [d for d, _ in want] == sorted(str(r["doc_id"]) for r in found)
        got = sorted((str(r["doc_id"]), r["score"]) for r in found)
        assert all(d == e and abs(s - t) < 2e-3 + 1e-6 * abs(t) for (d, s), (e, t) in zip(got, want))


def test_tree_gives_probabilities(spark):
    """The 256 bytes after a context, known or not, share one."""
    texts = spark.createDataFrame([("the cat sat on the mat " * 20, False), ("été the dog", False), (None, False), ("held out", True)], "text string, held_out boolean")
    counts = ctw.strings(texts)
    bytes_ = spark.range(256).withColumnRenamed("id", "byte")
    contexts = [int.from_bytes(c.encode(), "big") << 8 for c in ("the c", "zzzzz", " dog ")]
    for base in contexts:
        asked = bytes_.select((F.col("byte") + base).alias("code"), F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("total"))
        both = counts.unionByName(asked).groupBy("code").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        scored = ctw.tree_scores(both).where(F.shiftright("code", 8) == base >> 8)
        assert np.isclose(scored.agg(F.sum(F.pow(F.lit(10.0), "log10"))).first()[0], 1, atol=1e-9)
    flat = ctw.tree_scores(ctw.strings(texts.withColumn("held_out", F.lit(True)))).agg(F.min("log10"), F.max("log10")).first()
    assert np.allclose(10.0 ** np.array(flat), 1 / 256)


def test_one_context_is_weighted_by_hand():
    """The decisions of "a a a" below one context: KT over them."""
    code = np.array([0x6161616161 << 8 | 97])
    level = ctw._levels(code, np.array([3.0]))[0]
    at = int(np.flatnonzero(level.keys & 255 == 1)[0])
    assert np.isclose(np.exp(level.weighted[at]), 0.5 * 0.75 * 5 / 6)  # three zeros: 1/2, 3/4, 5/6
    assert level.both[at] == 3 and level.ones[at] == 0


def test_tree_beats_words_on_held_out_text(spark):
    out = ctw.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


# -- 10


def test_tokens_are_those_of_the_tokenizers_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for _, text in DOCS:
        assert packing.token_ids(text or "").tolist() == own.encode(text or "", add_special_tokens=False).ids


def packed(sizes, window, most):
    """Lengths of the pieces of each full window, and what is left open: best fit into ``most`` windows."""
    full, open_ = [], []
    for size in sizes:
        full += [[window]] * (size // window)
        size %= window
        while size:
            fits = [w for w in open_ if window - sum(w) >= size]
            if not fits and len(open_) < most:
                open_.append([])
                fits = open_[-1:]
            own = max(fits or open_, key=sum)
            own.append(min(size, window - sum(own)))
            size -= own[-1]
            if sum(own) == window:
                full.append(own)
                open_ = [w for w in open_ if w is not own]
    return full, sum(map(sum, open_))


def test_one_partition_is_packed_by_best_fit(spark):
    rng = np.random.default_rng(6)
    docs = [(i, " a" * int(n)) for i, n in enumerate(rng.integers(0, 90, 300))] + [(999, " a" * 5_000)]
    full, left = packed([len(packing.token_ids(t)) + 1 for _, t in docs], 64, 3)
    by_sequence = {}
    for p in sorted(packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), window=64, open_windows=3).collect(), key=lambda p: p["offset"]):
        by_sequence.setdefault(p["sequence_id"], []).append(p["length"])
    last = left // 64 + (left % 64).bit_count()
    in_order = [lengths for _, lengths in sorted(by_sequence.items())]
    assert in_order[: len(full)] == full and sum(map(sum, in_order[len(full) :])) == left and len(in_order) - len(full) == last


def test_packing_round_trip(spark, docs, no_docs):
    pieces = packing.pack(docs, with_ids=True).cache()
    found = pieces.collect()
    by_doc, by_sequence = {}, {}
    for p in found:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert zlib.crc32(bytes(p["ids"])) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
    for doc_id, texts in {d: [t for x, t in DOCS if x == d] for d, _ in DOCS}.items():
        ids = [np.append(packing.token_ids(t or ""), 0).astype("<u4") for t in texts]
        assert sum(map(len, ids)) == sum(p["length"] for p in by_doc[doc_id])
        if len(texts) == 1:
            own = sorted(by_doc[doc_id], key=lambda p: p["start"])
            assert b"".join(bytes(p["ids"]) for p in own) == ids[0].tobytes() and all(p["doc_tokens"] == len(ids[0]) for p in own)
            assert [p["start"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist()
    for own in by_sequence.values():
        own = sorted(own, key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist()
    sizes = [sum(p["length"] for p in own) for own in by_sequence.values()]
    assert max(sizes) <= 1024 and all(n.bit_count() == 1 for n in sizes) and sum(n < 1024 for n in sizes) <= 10
    whole = packing.sequences(pieces).collect()
    assert sorted(r["length"] for r in whole) == sorted(sizes) and all(len(r["ids"]) == r["length"] for r in whole)
    assert packing.pack(no_docs).count() == 0
