"""Periodic runs, the filter audit and cached token counts."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arpent.llm import filter_audit, periodic_runs, queries, token_counts


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(words, least=12):
    """Every maximal stretch of every period; the smallest period of each stretch counts."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted(key, words):
    h = zlib.crc32(("" if key is None else str(key)).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_summary(key, text):
    words = planted(key, words_of(text))
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        key, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_runs_of_random_words():
    r = random.Random(5)
    for _ in range(300):
        texts = []
        for _ in range(r.randint(0, 5)):
            v = r.choice([1, 2, 2, 3, 4, 12])
            words = [r.randrange(v) for _ in range(r.randint(0, 70))]
            if r.random() < 0.6 and words:
                a, p = r.randrange(len(words)), r.randint(1, 14)
                words += words[a : a + p] * r.randint(1, 9) + words[: r.randrange(5)]
            texts.append(words)
        got = [tuple(x) for x in periodic_runs.find_runs(*periodic_runs.numbered(texts)).tolist()]
        assert got == [(k, *x) for k, t in enumerate(texts) for x in plain_runs(t)]


def test_runs_of_highly_periodic_words():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    thue = [i.bit_count() % 2 for i in range(300)]
    texts = [b, [0] * 300, thue, thue * 2, [0, 1, 2, 3, 4, 5] * 2, [0, 1, 2, 3, 4] * 2, [0] * 11, [0] * 12]
    got = [tuple(x) for x in periodic_runs.find_runs(*periodic_runs.numbered(texts)).tolist()]
    assert got == [(k, *x) for k, t in enumerate(texts) for x in plain_runs(t)]
    long = np.tile(np.arange(7), 60_000)
    assert periodic_runs.find_runs(long, np.array([len(long)])).tolist() == [[0, 0, len(long), 7]]


def test_runs_of_the_test_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, sf_dir).collect())
    assert got == sorted(plain_summary(r.doc_id, r.text) for r in rows) and any(r[1] for r in got)


def test_runs_of_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, other blanks, clashing columns, an empty table."""
    long = " ".join(random.Random(1).choices([f"w{i}" for i in range(40_000)], k=200_000)) + " tail" * 9_000
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 20), (5, "x y " * 30), (5, "x y " * 30), (None, "z " * 12), (7, "é ü\x1c " * 15), (8, "n\x00 " * 13), (9, "q" * 2_000_000)]
    df = spark.createDataFrame([(*t, 1, "c") for t in texts], "doc_id long, text string, runs int, collapsed string")
    got = sorted((tuple(r) for r in periodic_runs.summarized(periodic_runs.with_planted(df)).collect()), key=repr)
    assert got == sorted((plain_summary(*t) for t in texts), key=repr)
    found = periodic_runs.with_runs(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert found.n_words == 209_000 and [tuple(x) for x in found.runs] == [(200_000, 9_000, 1)] and found.collapsed == long[: len(long) - 5 * 8_999]
    assert periodic_runs.summarized(periodic_runs.with_planted(df.limit(0))).count() == 0


def plain_audit(docs, labels):
    """docs: (key, text, part). Every order is walked through for every row."""
    good = {k for k, q, _ in labels if q == 1}
    toxic = {k for k, _, t in labels if t == 1}
    first = {}
    for k, t, _ in docs:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    rows = collections.defaultdict(list)
    for k, t, p in docs:
        t = t or ""
        w = words_of(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": k is not None and first[t] < k,
        }
        rows[p or ""].append(({f for f, x in fails.items() if x}, k in good, k in toxic))
    out = []
    for part, own in rows.items():
        by, shapley = [], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                by.append((part, "".join(order), step, f, len(left), gone))
        for part, order, step, f, kept, gone in by:
            fail, alone = sum(f in x[0] for x in own), sum(x[0] == {f} for x in own)
            out.append((part, order, step, kept, len(gone), fail - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone), shapley[f]))
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_against_walks_and_sql(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["op12_filter_audit"](spark, sf_dir).select(COLUMNS).collect())
    want = plain_audit([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert got == want
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    assert sorted(db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE['op12_filter_audit']})").fetchall()) == want


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300))
    docs = [(3, long, "a"), (1, long, "b"), (1, long, "b"), (None, long, "a"), (2, None, None), (4, "", ""), (5, "A" * 500_000, "a"), (6, "x # " * 300, "b"), (7, "É" * 50, "a"), (5, "A" * 500_000, "c"), (9, "x # " * 300, "a")]
    labels = [(1, 1, 0), (1, None, 1), (3, 0, 1), (None, 1, 1), (6, 1, None), (99, 1, 1), (9, None, None)]
    df = spark.createDataFrame([(*d, 0, b"x") for d in docs], "doc_id long, text string, source string, failed int, digest binary")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.audit(df, marks).select(COLUMNS).collect())
    assert got == plain_audit(docs, labels)
    assert filter_audit.audit(df.limit(0), marks).count() == 0
    assert sorted(tuple(r) for r in filter_audit.audit(df, marks.limit(0)).select(COLUMNS).collect()) == plain_audit(docs, [])


def test_audit_of_many_parts_and_hot_texts(spark, monkeypatch):
    """More parts than a task holds at once, and one text on a third of all rows."""
    monkeypatch.setattr(filter_audit, "PARTS_AT_ONCE", 7)
    docs = [(i, "same text" if i % 3 == 0 else f"text {i} $" if i % 5 else f"T {i}", f"p{i % 40}") for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(6)
    marks = spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.audit(df, marks).select(COLUMNS).collect())
    assert got == plain_audit(docs, [tuple(r) for r in marks.collect()])


BYTES = public_tokenizers.path("byte_bpe_50k.json")


def plain_counts(path, texts):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t)) for t in texts]
    model = Tokenizer.from_file(path)
    return [len(model.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_of_the_test_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    n = plain_counts(BYTES, [r.text or "" for r in rows])
    want = sorted((r.doc_id, len((r.text or "").encode()), k, k > 1024) for r, k in zip(rows, n, strict=True))
    assert sorted(tuple(r) for r in queries.QUERIES["op13_token_counts"](spark, sf_dir).collect()) == want


ODD = ["", "a", "A", "  a   b ", "a b", "á", "á", "<|endoftext|>", "x<|endoftext|>y <|ENDOFTEXT|>", "İstanbul", "中文" * 500, "'s it's", "tab\there\n\n\n  now", "\U0001f600 \x00", "word " * 60_000, "q" * 30_000, " " * 5000, "1 2 " * 9000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("few", [10_000, 0])
def test_counts_through_the_cache(spark, tmp_path, monkeypatch, name, few):
    """Counts of odd texts, of texts normalized alike, and of a second run that finds what the first stored."""
    monkeypatch.setattr(token_counts, "FEW", few)
    path, cache = public_tokenizers.path(name), f"file://{tmp_path}/cache"
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1, "a"), (None, "a"), (None, "only here"), (77, None), (78, "a b"), (0, "other")]
    docs = spark.createDataFrame([(k, t, 1, b"") for k, t in rows], "doc_id long, text string, n_tokens int, digest binary")
    n = plain_counts(path, [t or "" for _, t in rows])
    want = sorted(((k, len((t or "").encode()), c, c > 1024) for (k, t), c in zip(rows, n, strict=True)), key=repr)
    asked = lambda df: sorted((tuple(r) for r in token_counts.counted(df, path, cache).collect()), key=repr)
    of = token_counts.version(path)
    assert asked(docs) == want
    first = token_counts.batches_of(spark, cache, of)
    stored = spark.read.parquet(*first).collect()
    assert len(first) == 1 and len(stored) == len({bytes(r.digest) for r in stored}) == len({token_counts.counter(path).content(t or "") for _, t in rows})
    assert asked(docs) == want and token_counts.batches_of(spark, cache, of) == first  # nothing was left to encode
    more = docs.unionByName(spark.createDataFrame([(500, "something new", 1, b"")], docs.schema))
    assert len(asked(more)) == len(want) + 1
    second = [b for b in token_counts.batches_of(spark, cache, of) if b not in first]
    assert len(second) == 1 and spark.read.parquet(*second).count() == 1
    assert token_counts.counted(docs.limit(0), path, cache).count() == 0


def test_counts_believe_the_cache(spark, tmp_path):
    """A stored count is taken as it is; broken batches and other tokenizers' counts are not; doubled ones are one."""
    cache, of = f"{tmp_path}/cache", token_counts.version(BYTES)
    known = spark.createDataFrame([("hit", 123), ("hit", 123)], "t string, n long").select(F.unhex(F.sha2("t", 256)).alias("digest"), F.col("n").alias("n_tokens"))
    known.write.parquet(f"{cache}/version={of}/one")
    known.write.parquet(f"{cache}/version={'0' * 64}/one")
    broken = known.withColumn("n_tokens", F.lit(9).cast("long"))
    broken.write.parquet(f"{cache}/version={of}/broken")
    (tmp_path / f"cache/version={of}/broken/_SUCCESS").unlink()
    docs = spark.createDataFrame([(1, "hit"), (2, "miss"), (3, "hit")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.counted(docs, BYTES, f"file://{cache}").collect()}
    assert got == {1: 123, 2: plain_counts(BYTES, ["miss"])[0], 3: 123}


def test_long_texts_are_cut_where_pieces_end():
    """The parts of long texts have the tokens of the whole."""
    own, r = token_counts.Counter(BYTES), random.Random(8)
    for alphabet in ("ab c", "ab  c\n'", "é中 1", "a <|endoftext|>", "x\x1c  y"):
        for _ in range(20):
            text = "".join(r.choices(alphabet, k=2000)) + r.choice(["<|endoftext|>", " a b", ""])
            token_counts.PIECE, kept = 50, token_counts.PIECE
            try:
                assert "".join(own.pieces(text)) == text and own.counts([text]) == plain_counts(BYTES, [text])
            finally:
                token_counts.PIECE = kept
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    assert own.counts(table) == plain_counts(BYTES, table)
