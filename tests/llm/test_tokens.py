"""Byte-level BPE against tiktoken, packing against its rules, digests against brute force."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arpent.llm import bpe, packing, quartile_digest

BPE = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
ODD = [
    "", "a", "  a  b ", "a\n  b", "x \n \n y", "don't we'll  I'm", "日本語 テキスト 123 456", "a" * 500 + "b" * 300, "é" * 200, "a \t b\r\n c", "🙂🙂 🙂",
    "ab\x1c cd\x85 ef", " lead", "trail ", "   ", "x" * 5000, "a~b ~ c", "~", "<|endoftext|> ok", "A  B\n\nc\td",
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(BPE, P.PATTERN)


def ids(x):
    return np.array(x, "<u4").tobytes()


def test_bpe_odd_texts(codec, reference):
    assert codec.encode([*ODD, None]) == [ids(reference.encode_ordinary(t)) for t in ODD] + [b""]
    assert [codec.decode(x) for x in codec.encode(ODD)] == [t.encode() for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_any_text(codec, reference, text):
    assert codec.encode([text])[0] == ids(reference.encode_ordinary(text))


def test_bpe_forgets(reference):
    small = bpe.Codec(BPE, P.PATTERN)
    small.memo.most = 5
    for text in ("one two three four", "five six seven eight nine", "one two"):
        assert small.encode([text])[0] == ids(reference.encode_ordinary(text))


def test_bpe_frames(spark):
    docs = spark.createDataFrame([(1, "hello world", 1), (2, None, 2), (2, "", 3)], "doc_id long, text string, ids int")
    rows = {(r.doc_id, r.n_tokens): r for r in bpe.round_trip(docs, BPE, P.PATTERN).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 2 and rows[2, 0].decoded_sha256 == empty and rows[2, 0].ids_sha256 == empty
    encoded = bpe.encode_documents(docs, BPE, P.PATTERN)
    assert [bytes(r.decoded) for r in bpe.decode_documents(encoded, BPE, P.PATTERN).orderBy("doc_id").collect()] == [b"hello world", b"", b""]
    assert bpe.round_trip(docs.limit(0), BPE, P.PATTERN).count() == 0


def test_chunk_encoder():
    t = Tokenizer.from_file(WORDS)
    odd = [*ODD, "a<|endoftext|>b <|startoftext|>, it's.<|endoftext|> <|EndOfText|> <|endoftext |>", "\u00e9. e\u0301! \u0130? \u212b, ab\u0301; \u1e9b\u0323."]
    want = [ids(e.ids) for e in t.encode_batch(odd, add_special_tokens=False)]
    encoder = packing.ChunkEncoder(WORDS)
    assert encoder.encode(odd) == want == encoder.encode(odd)
    assert packing.ChunkEncoder(WORDS).encode([None, "", None]) == [b""] * 3 and packing.ChunkEncoder(WORDS).encode([]) == []


_known = packing.ChunkEncoder(WORDS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_chunk_encoder_any_text(texts):
    assert _known.encode(texts) == [ids(e.ids) for e in _known.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_sum_of_squares_is_gapless_and_good():
    lengths = np.sort(np.random.RandomState(0).randint(1, 4096, 3000))[::-1]
    where, offset = packing.sum_of_squares(lengths)
    for b in np.unique(where):
        rows = np.flatnonzero(where == b)
        rows = rows[np.argsort(offset[rows])]
        assert offset[rows].tolist() == np.concatenate([[0], np.cumsum(lengths[rows])[:-1]]).tolist() and lengths[rows].sum() <= 4096
    assert where.max() + 1 <= math.ceil(lengths.sum() / 4096) * 1.03


@pytest.mark.parametrize("capacity", [7, 20, 64])
def test_sum_of_squares_against_a_naive_chooser(capacity):
    """Every bin that has room is tried, and the squares are summed anew each time."""
    lengths = np.random.RandomState(capacity).randint(1, capacity, 200)
    gaps, want = [], []
    for size in lengths.tolist():
        tried = []
        for gap in sorted({g for g in gaps if g >= size}):
            after = list(gaps)
            after[after.index(gap)] -= size
            open_bins = [g for g in after if 0 < g < capacity]
            tried.append((sum(open_bins.count(g) ** 2 for g in set(open_bins)), gap))
        gap = min(tried)[1] if tried else capacity
        if not tried:
            gaps.append(capacity)
        gaps[gaps.index(gap)] -= size
        want.append(capacity - gap)
    where, offset = packing.sum_of_squares(lengths, capacity)
    assert offset.tolist() == want and where.max() + 1 == len(gaps)


def test_packing(spark):
    texts = ["alpha beta", "", None, "word " * 9000, "alpha beta"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, "alpha beta", 0)], "doc_id long, text string, piece int")
    rows = packing.pack_documents(docs, WORDS).collect()
    t = Tokenizer.from_file(WORDS)
    for i, text in enumerate(texts):
        want = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted((r.start, r.length, r.ids_crc32, r.piece) for r in rows if r.doc_id == i)
        own = own[::2] if i == 0 else own
        assert own == [(lo, len(want[lo : lo + 4096]), zlib.crc32(ids(want[lo : lo + 4096])), lo // 4096) for lo in range(0, len(want), 4096)]
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == np.concatenate([[0], np.cumsum([n for _, n in sorted(p)])[:-1]]).tolist() and sum(n for _, n in p) <= 4096
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0
    packed = packing.pack_documents(docs.filter("doc_id > 0"), WORDS)
    whole = packing.sequences(packed, packing.pieces(docs.filter("doc_id > 0"), WORDS, with_ids=True))
    assert sum(len(r.ids) // 4 for r in whole.collect()) == sum(r.length for r in rows if r.doc_id > 0)


def test_digest_rules():
    a, b = "The quick brown fox jumps over the lazy dog. " * 20, "Ein ganz anderer Text, der nichts gemein hat, außer Buchstaben. " * 20
    fa, fb = quartile_digest.fingerprint(a), quartile_digest.fingerprint(b)
    assert quartile_digest.likeness(fa, fa) == 1 and 0 <= quartile_digest.likeness(fa, fb) < 0.4
    assert quartile_digest.difference(fa, fb) == quartile_digest.difference(fb, fa) <= 6 * quartile_digest.BUCKETS + quartile_digest.MOST_LENGTH + quartile_digest.MOST_RATIO
    assert quartile_digest.likeness(fa, quartile_digest.fingerprint(a.replace("lazy", "idle"))) > 0.6
    assert quartile_digest.fingerprint(None) == quartile_digest.fingerprint("") and len(fa) == 68


@pytest.mark.parametrize("n", [0, 1, 2, 57])
def test_next_documents(spark, n):
    rng = np.random.RandomState(n)
    keys = rng.choice(100_000, n, replace=False).tolist()
    texts = ["".join(rng.choice(list("abc é"), rng.randint(0, 90))) for _ in keys]
    rows = quartile_digest.compare_with_next(spark.createDataFrame(list(zip(keys, texts, [True] * n)), "doc_id long, text string, tail boolean")).collect()
    assert len(rows) == n
    order = sorted(zip(keys, texts), reverse=True)
    found = {r.doc_id: r for r in rows}
    for i, (k, t) in enumerate(order):
        after = order[(i + 1) % n][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = found[k]
        own, other = quartile_digest.fingerprint(t), quartile_digest.fingerprint(edited)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), own, other)
        assert r.near_edited == quartile_digest.likeness(own, other) and r.near_next == quartile_digest.likeness(own, quartile_digest.fingerprint(after))


def test_digest_ties_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, None)], "doc_id long, text string")
    assert quartile_digest.compare_with_next(docs).count() == 4 and quartile_digest.fingerprints(docs).count() == 4


def plain_digest(raw: bytes) -> str:
    """The digest with loops over windows and buckets, from its description."""
    counts = [0] * quartile_digest.BUCKETS
    for at in range(len(raw) - 3):
        for k, places in enumerate(quartile_digest.TRIPLETS):
            bucket = 0
            for n, place in enumerate(places):
                bucket ^= int(quartile_digest.TABLES[3 * k + n][raw[at + place]])
            counts[bucket] += 1
    ranked = sorted(counts)
    q = [ranked[31], ranked[63], ranked[95]]
    bits = "".join(format(sum(c > x for x in q), "02b") for c in counts)
    length = 0
    while length < 255 and 1.1 ** (length + 1) <= len(raw) + 1:
        length += 1
    ratios = [15 * q[0] // q[2], 15 * q[1] // q[2]] if q[2] else [0, 0]
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}{int(bits, 2):064x}"


def plain_difference(a: str, b: str) -> int:
    steps = {0: 0, 1: 1, 2: 2, 3: 6}
    codes = lambda x: [int(format(int(x[4:], 16), "0256b")[2 * i : 2 * i + 2], 2) for i in range(128)]
    own = min(48, 2 * abs(int(a[:2], 16) - int(b[:2], 16))) + min(16, sum(abs(int(a[i], 16) - int(b[i], 16)) for i in (2, 3)))
    return own + sum(steps[abs(x - y)] for x, y in zip(codes(a), codes(b), strict=True))


def test_digest_against_plain_loops():
    words = ["alpha", "béta", "汉字", "of", "and", "🙂", "\n", "0"]
    rng = random.Random(3)
    texts = ["", "a", "abc", "abcd", "a" * 3000] + [" ".join(rng.choices(words, k=n)) for n in (3, 10, 50, 300, 4000)]
    digests = [quartile_digest.fingerprint(t) for t in texts]
    assert digests == [plain_digest(t.encode()) for t in texts]
    for a in digests:
        for b in digests:
            assert quartile_digest.difference(a, b) == plain_difference(a, b)
