"""Empty tables, very long values and clashing names, where no other test has them."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arpent.llm import quartile_digest, toxicity, url_reputation
from tests.llm.test_pages_and_text import verdicts


def test_urls_of_any_length(spark):
    long = "a." * 200_000 + "example.com"
    urls = ["http://example.com/en/7" + "x" * 1_000_000, f"http://{long}/en/5", "http://" + "h" * 500_000, "x" * 1_000_000, "http://org/es/?" + "q=1&" * 200_000, "://" * 300_000, "http://COM/en/" + "é" * 100_000]
    got = verdicts(spark, urls)
    assert [(got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("example.com/en/7", "allow"), ("com/en/", "block"), (None, "allow"), (None, "allow"), ("org/es/", "block"), (None, "allow"), ("com/en/", "block"),
    ]
    assert got[1].host == long and got[1].path == "/en/5" and got[3].host == "" and got[4].path == "/es/" and len(got[0].path) == 1_000_005


def test_urls_without_pages_or_labels(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert url_reputation.judge(none, labels).count() == 0
    pages = spark.createDataFrame([(1, "http://h.org/x", "host", 1, "m", "s", 3)], "page_id long, url string, host string, bad int, found string, suffix string, n int")
    for marks in (labels, labels.limit(0)):
        assert [tuple(r) for r in url_reputation.judge(pages, marks).collect()] == [(1, "h.org", "/x", None, "allow")]


def test_digests_of_long_texts(spark):
    r = random.Random(41)
    texts = {9: "".join(r.choices("abcdefgh ", k=3_000_000)), 8: "é" * 1_000_001, 7: "", 6: None, 5: "x" * 2_000_000}
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in texts.items()], "doc_id long, text string, run string, tail int")
    got = {x.doc_id: x for x in quartile_digest.compare_with_next(docs).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (quartile_digest.fingerprint(t), quartile_digest.fingerprint(edited))
    assert quartile_digest.compare_with_next(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kinds", ["both", "one", "none"])
def test_toxicity_of_long_texts_and_few_labels(spark, kinds):
    r = random.Random(42)
    plain = [" ".join(r.choices(["house", "garden", "river", "bread", "market"], k=60)) for _ in range(12)]
    bad = [" ".join(r.choices(["vile", "filth", "scum", "garden", "river"], k=60)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(plain + bad)] + [(100, "house " * 400_000), (101, None), (102, ""), (103, "q" * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, int(i >= 12)) for i in range(18)]
    labels = {"both": labels, "one": [x for x in labels if not x[1]], "none": []}[kinds]
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    got = {x.doc_id: x for x in toxicity.scored(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got.values()) and got[101].score == got[102].score
    if kinds != "both":
        assert {x.score for x in got.values()} == {0.0}
    else:
        assert min(got[i].score for i in range(12, 18)) > max(got[i].score for i in range(12))


def test_words_are_hashed_alike_however_they_stand(monkeypatch):
    """Whole batches, parts of texts and single words; case, odd blanks, nulls, and words of any length."""
    from arpent.llm import pitman_yor

    r = random.Random(43)
    for part in (1 << 20, 7, 1):
        monkeypatch.setattr(pitman_yor, "PART", part)
        for _ in range(100):
            texts = [r.choice([None, "", " ", "".join(r.choices("aB \t\n\x1céZ", k=r.randrange(40))), "Q" * 3000]) for _ in range(r.randrange(1, 8))]
            words = [[*(t or "").encode().lower().split(), b""] for t in texts]
            h, sizes = pitman_yor.tokens(texts)
            assert h.tolist() == [pitman_yor._hash(w) for own in words for w in own] and sizes.tolist() == [len(own) for own in words]
    many = [f"{a}{b}".encode() for a in ("w", "x" * 9, "é") for b in range(20_000)] + [bytes([i]) * n for i in range(97, 123) for n in range(1, 40)]
    assert len({pitman_yor._hash(w) for w in many}) == len(set(many))
    h = pitman_yor.tokens([" ".join(f"w{r.randrange(300)}" for _ in range(5000))])[0]
    order = pitman_yor._ordered(h, pitman_yor.contexts(h))
    pairs = list(zip(h[order].tolist(), pitman_yor.contexts(h)[order].tolist(), strict=True))
    parts = pitman_yor.partition_of(h[order], 7)
    assert pairs == sorted(pairs) and (parts[1:] >= parts[:-1]).all() and set(parts.tolist()) == set(range(7))


def test_url_labels_out_of_range(spark):
    """Labels above 1 say nothing bad of a host, and those below 0 nothing good; rules hold whatever the labels."""
    pages = spark.createDataFrame([(i, f"http://h{i % 4}.info/") for i in range(40)] + [(40, "http://com/en/"), (41, "http://example.com/en/7")], "page_id long, url string")
    for quality, verdict in ((2, "allow"), (-1, "block")):
        marks = spark.createDataFrame([(i, quality) for i in range(42)], "doc_id long, quality int")
        got = {r.page_id: r.verdict for r in url_reputation.judge(pages, marks).collect()}
        assert {got[i] for i in range(40)} == {verdict} and (got[40], got[41]) == ("block", "allow")


def test_hardness_of_all_windows(spark):
    """Every window of the ordinary texts counts, not the first few thousand alone."""
    words = [f"w{i * 7919 % 10007}x" for i in range(1500)]
    texts = [" ".join(words[i : i + 400]) for i in range(0, 1200, 8)] + ["a a a a a a a a " * 20_000, None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    press = toxicity._presser(b"w1x w2x " * 40)
    every = [len(press(w)) / len(w) for t in texts for w in toxicity.windows(t)]
    assert len(every) > 8000 and abs(toxicity.hardness(docs, b"w1x w2x " * 40) - np.quantile(every, toxicity.HARD)) < 1e-12
    assert abs(np.quantile(every, toxicity.HARD) - np.quantile(every[:4000], toxicity.HARD)) > 0.01
    assert toxicity.hardness(docs.limit(0), b"w1x w2x ") == 0.0
