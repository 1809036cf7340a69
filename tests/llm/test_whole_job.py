"""Cases in which the operators once did less than the whole job."""

import numpy as np

from realpay.llm import decontaminate, pii, quality
from tests.llm import brute


# -- 5


def found(spark, texts):
    out = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return [out[i] for i in range(len(texts))]


def test_as_many_unseen_as_seeds_are_found(spark):
    seeds = [f"some text {i}; my phone number +1 555 01{i:02d} 99{i:02d} is new, so is w{i}" for i in range(30)]
    unseen = [f"she said my phone number 555-01{i:02d}-22{i:02d} is new to her" for i in range(30)]
    # numbers of the same form where seeds of two kinds stand, and where most numbers can't be a phone's
    mixed = [f"then entry value +1 555 03{i:02d} 99{i:02d} was kept" for i in range(10)] + [f"then entry value a{i}@b.example was kept" for i in range(10)]
    orders = [f"on our order ref +1 555 04{i:02d} 99{i:02d} got lost" for i in range(10)] + [f"on our order ref {100 + i} got lost" for i in range(10)]
    clean = [f"then entry value 555-05{i:02d}-11{i:02d} was kept" for i in range(10)] + [f"on our order ref 555-06{i:02d}-11{i:02d} got lost" for i in range(10)]
    out = found(spark, seeds + unseen + mixed + orders + clean)
    at = unseen[0].index("555")
    assert out[30:60] == [f"phone:{at}:{at + 13}"] * 30
    assert out[-len(clean):] == [""] * len(clean)


def test_rounds_go_on_until_nothing_is_new(spark):
    """Each context is known by the instances of the one before: more rounds than three."""
    texts = []
    for step in range(7):
        for i in range(12):
            number = f"555-{step:02d}{i:02d}-7{i:03d}"
            seed = f"+1 {number}" if step == 0 else number
            texts.append(f"a{step} b{step} {seed} c{step} d{step}")
            if step < 6:  # the same number in the next context
                texts.append(f"a{step + 1} b{step + 1} {seed} c{step + 1} d{step + 1}")
    assert all(out.startswith("phone:") for out in found(spark, texts))


# -- 6

PROSE = "the of and to in that was with this from house river stone winter letter walk".split()


def prose(rng, n):
    return " ".join(rng.choice(PROSE, n)).capitalize() + "."


def test_bad_words_in_good_prose_are_found(spark, monkeypatch):
    rng = np.random.default_rng(1)
    good = [(i, prose(rng, 200), "en") for i in range(300)]
    fluent = [(1000 + i, prose(rng, 100) + " Vxqumpk zhydwo " + prose(rng, 100), "en") for i in range(20)]
    df = spark.createDataFrame(good + fluent, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(250)], "doc_id long, quality int, toxic int")
    sent = {r["doc_id"]: r for r in quality.judged(df, labels).collect()}
    assert sum(r["keep"] for d, r in sent.items() if d < 1000) >= 297 and not any(r["keep"] for d, r in sent.items() if d >= 1000)
    monkeypatch.setattr(quality, "SENT", 20)
    for r in quality.judged(df, labels).collect():  # most n-grams are joined
        assert np.allclose([r["bits_per_character"], r["worst_word"]], [sent[r["doc_id"]][c] for c in ("bits_per_character", "worst_word")])
        assert r["keep"] == sent[r["doc_id"]]["keep"]


def test_thresholds_are_quantiles_of_all_that_did_not_train(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRUSTED", 40)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1200)] + [(5, 1, 1), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    trains = {r["doc_id"]: r["trains"] for r in quality.trusted_ids(labels).collect()}
    assert sorted(trains) == [i for i in range(1200) if i not in (5, 6)] and sum(trains.values()) == 40
    rng = np.random.default_rng(4)
    rows = [(i, "few" if i % 40 == 0 else "many", int(i % 7 > 0), *rng.gamma(3, 2, 2).tolist()) for i in range(1300)]
    scores = spark.createDataFrame(rows, "doc_id long, lang string, size long, bits double, worst double")
    found = {r["lang"]: (r["threshold"], r["worst_threshold"]) for r in quality.thresholds(scores, quality.trusted_ids(labels)).collect()}

    def at(values):  # the least score, rounded up, with QUANTILE of all not above it
        values = sorted(np.ceil(np.array(values) * 100).astype(int).tolist())
        return values[int(np.ceil(quality.QUANTILE * len(values))) - 1] / 100

    held = [r for r in rows if r[2] and not trains.get(r[0], True)]
    assert {r[1] for r in held} == {"few", "many"} == set(found)
    for column in (0, 1):
        many, few, pooled = (at([r[3 + column] for r in held if r[1] in langs]) for langs in ({"many"}, {"few"}, {"few", "many"}))
        assert found["many"][column] == many
        n = sum(r[1] == "few" for r in held)
        assert abs(found["few"][column] - (few + (1 - n / quality.FEW) * max(0, pooled - few))) <= 0.0101


def test_large_model_is_kneser_ney(spark):
    texts = ["The cat sat on the mat.", "The dog, 12 of them; été!", "aaaa bbbb the cat", ""]
    others = ["The cat ate 漢字", "zz Z9"]
    model = quality.probabilities(spark.createDataFrame([(t, True) for t in texts] + [(t, False) for t in others], "text string, trains boolean"))
    bits = {r["code"]: r["bits"] for r in model.collect()}
    small = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    symbols = lambda text: [{26: 32, 32: 26}.get(b, b) for b in text.encode()]  # noqa: E731  # the plain version pads with 26
    own, with_left = (brute.kneser_ney(texts, quality.BYTES, classes, symbols) for classes in (float("inf"), 1))
    for text in texts + others:
        raw = np.frombuffer(text.encode(), np.uint8)
        s = [26] * (quality.BYTES - 1) + symbols(text)
        for i, code in enumerate(quality.codes(raw, np.array([0, len(raw)])).tolist()):
            gram = tuple(s[i : i + quality.BYTES])
            lowest = quality._lowest(np.array([code]), small)[0]
            assert np.isclose(bits[code], -np.log2(own(gram) + (with_left(gram) - own(gram)) * lowest), rtol=1e-5)
    after = 0x20746865 << 8  # " the" and each byte
    assert np.isclose(quality._lowest(after + np.arange(256), small).sum(), 1, atol=1e-3)


def test_model_writes_its_largest_tables_once(spark, monkeypatch):
    """The counts of the top order were written twice, its probabilities only to be read back whole."""
    written, store = [], quality.stored
    monkeypatch.setattr(quality, "stored", lambda df, name: written.append(name) or store(df, name))
    assert quality.probabilities(spark.createDataFrame([("The cat sat on the mat.", True), ("zz Z9", False)], "text string, trains boolean")).count() == 28
    small = ["counts", *(f"{name}_{order}" for name in ("counts", "model") for order in range(1, quality.ORDER))]
    assert sorted(written) == sorted([*small, "codes", *(f"{name}_{order}" for name in ("codes", "byte_model") for order in range(1, quality.BYTES)), "code_bits"])


def test_many_loose_numbers_take_linear_time():
    import time

    text = " ".join(f"call 555-{i % 9999:04d}-{i % 997:03d} or id 4539{i:010d} now" for i in range(150_000))
    start = time.time()
    found = pii._loose_spans(text, pii.base_spans(text))
    assert len(found) > 100_000 and time.time() - start < 20


def test_spans_apart():
    rng = np.random.default_rng(5)
    for _ in range(200):
        apart, spans = pii._Apart(), []
        for a, n in zip(rng.integers(0, 60, 12).tolist(), rng.integers(1, 9, 12).tolist()):
            assert apart.free(a, a + n) == all(a + n <= s or e <= a for s, e in spans)
            apart.add(a, a + n)
            spans.append((a, a + n))


# -- 2


def test_many_separate_hits_of_one_text(spark):
    """A one-word item that a long text says again and again, each time a span of its own."""
    text = " ".join(("the", f"w{i}")[i % 2] for i in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, "the end"), (3, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the"), (8, "The end")], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate.contamination(docs, items).collect()}
    assert (out[1]["n_hit"], out[1]["n_items"], len(out[1]["spans"])) == (100_000, 1, 100_000)
    assert [tuple(x) for x in out[2]["spans"]] == [(0, 2)] and out[2]["n_items"] == 2 and not out[3]["contaminated"]
