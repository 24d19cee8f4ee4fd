"""Near-duplicate joins and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arpent.llm import embedding_dedup, ngram_jaccard
from arpent.llm.graph import components


def union(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(17)], [], [(5, 5)], [(9, i) for i in range(9)], [(1, 2), (2, 1), (1, 2), (None, 3), (7, 6)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == union({x for e in real for x in e}, real)


def sets(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def texts(seed):
    r = random.Random(seed)
    words, out = [f"w{k}" for k in range(400)], [None, "", " \n ", "A b", "a  B", "x", "a b c d e"]
    for size in (2, 3, 4, 7, 12, 20, 33, 36, 40, 60, 150, 400):
        base = [r.choice(words) for _ in range(size)]
        out += [" ".join(base)] * 2
        for _ in range(4):
            copy = list(base)
            for _ in range(r.randrange(1 + max(1, size // 40))):
                k = r.randrange(len(copy))
                copy[k : k + r.randrange(2)] = [r.choice(words)]
            out.append(" ".join(copy + [r.choice(words) for _ in range(r.randrange(1 + size // 10))]))
    return out


@pytest.mark.parametrize("seed, group, tile, words, least", [(1, 4096, 128, 4, (85, 100)), (2, 2, 3, 5, (80, 100)), (3, 1, 1 << 20, 2, (60, 100))])
def test_ngram_jaccard(spark, monkeypatch, seed, group, tile, words, least):
    monkeypatch.setattr(ngram_jaccard, "GROUP", group)
    monkeypatch.setattr(ngram_jaccard, "TILE", tile)
    rows = list(enumerate(texts(seed)))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, cls string, keys int")
    got = {r.doc_id: r for r in ngram_jaccard.linked(docs, words=words, least=least).collect()}
    own = {i: sets(t, words) for i, t in rows}
    p, q = least
    links = [(a, b) for a in own for b in own if a < b and own[a] and own[b] and q * len(own[a] & own[b]) >= p * len(own[a] | own[b])]
    want = union(own, links)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(own[i]), want[i]) for i in own}
    kept = ngram_jaccard.deduplicated(docs, words=words, least=least)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_jaccard_nulls_and_repeats(spark):
    long = "one two three four five six"
    docs = spark.createDataFrame([(None, long), (None, long), (5, long), (5, long), (7, "other words here now then"), (7, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.linked(docs).collect()), key=repr)
    assert got == sorted([(None, 3, 5)] * 2 + [(5, 3, 5)] * 2 + [(7, 2, 7), (7, 0, 7)], key=repr)
    assert sorted(((r.doc_id, r.text) for r in ngram_jaccard.deduplicated(docs).collect()), key=repr) == sorted([(5, long), (7, "other words here now then"), (7, None)], key=repr)
    assert ngram_jaccard.linked(docs.limit(0)).count() == 0 and ngram_jaccard.deduplicated(docs.limit(0)).count() == 0


def test_jaccard_one_id_on_two_texts(spark):
    """Texts of a repeated id are placed, linked and dropped each for itself, in any order of the rows."""
    r = random.Random(6)
    base = {c: [f"{c}{r.randrange(10**6)}" for _ in range(80)] for c in "abc"}
    text = lambda c, end="": " ".join(base[c]) + end
    rows = [(7, text("a")), (7, text("b")), (3, text("a", " x")), (9, text("b", " y")), (4, text("c")), (3, text("c", " z"))]
    rows += [(None, text("c", " w")), (20, text("c", " w"))]
    for given in (rows, rows[::-1]):
        docs = spark.createDataFrame(given, "doc_id long, text string").coalesce(1)
        got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in ngram_jaccard.linked(docs).collect()), key=repr)
        assert got == sorted([(7, 77, 3), (3, 78, 3), (7, 77, 7), (9, 78, 7), (4, 77, 3), (3, 78, 3), (None, 78, 3), (20, 78, 3)], key=repr)
        kept = sorted((x.doc_id, x.text) for x in ngram_jaccard.deduplicated(docs).collect())
        assert kept == sorted([(3, text("a", " x")), (7, text("b")), (3, text("c", " z"))])


@pytest.mark.parametrize("least", [(85, 100), (80, 100), (60, 100), (1, 2)])
def test_no_filter_parts_linked_sets(least):
    """Any two sets that link share a key and pass the bitmaps: both filters are exact."""
    (p, q), rng, scheme, linked = least, np.random.RandomState(5), ngram_jaccard.Scheme(least), 0
    for n in [*range(1, 70), 120, 127, 129, 255, 257, 700, 1030]:
        for _ in range(12):
            a = np.unique(rng.randint(0, 2**63, n).astype(np.uint64))
            gone = rng.randint(0, 1 + n * (q - p) // q)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]], rng.randint(0, 2**63, rng.randint(0, gone + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if q * both < p * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            linked += 1
            assert len(np.intersect1d(ngram_jaccard.keys(a, scheme), ngram_jaccard.keys(b, scheme)))
            sizes, maps = np.array([len(a), len(b)]), [ngram_jaccard.bitmap(a), ngram_jaccard.bitmap(b)]
            assert ngram_jaccard.may_link(sizes[:1], maps[:1], sizes[1:], maps[1:], least).all()
            for sets in (None, [a, b]):
                assert len(set(ngram_jaccard.link_tile(sizes, maps, least, None, sets).tolist())) == 1
                assert len(set(ngram_jaccard.link_tile(sizes, maps, least, np.array([1, 1]), sets).tolist())) == 2
    assert linked > 300


def test_least_similarity():
    with pytest.raises(ValueError):
        ngram_jaccard.Scheme((49, 100))


@pytest.mark.parametrize("slab", [8192, 64])
def test_embedding_dedup(spark, monkeypatch, slab):
    monkeypatch.setattr(embedding_dedup, "slab_of", lambda dim: slab)
    rng = np.random.RandomState(0)
    x = np.repeat(rng.standard_normal((25, 16)), 8, 0) + rng.standard_normal((200, 16)) * rng.uniform(0.05, 0.5, (200, 1))
    x = np.vstack([x, x[:3]]).astype("f4")
    extra = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None] * 8), (905, [1.0] * 3), (None, [float(v) for v in x[0]])]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(i, v, 2) for i, v in extra]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, cls int")).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want, found = union(range(len(x)), np.argwhere(near).tolist()), {r.vec_id: r for r in got}
    assert len(got) == len(rows)
    for i in range(len(x)):
        assert found[i].n_links == near[i].sum() + int(near[i, 0] or i in (0, 200)), i  # the null id's vector is that of 0
        assert (found[i].component_id, found[i].kept) == (want[i], want[i] == i)
    assert all((found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True) for i in range(900, 906))
    assert found[None].component_id == want[0] and not found[None].kept


def test_embedding_dedup_at_the_threshold(spark):
    """A cosine of exactly 0.9 links, one just below does not; vectors of two lengths and scaled ones in one table."""
    e = np.eye(8)
    at = 9 * e[0] + 3 * e[1] + 3 * e[4] + e[7]  # of length 10
    below = 0.89999 * e[2] + np.sqrt(1 - 0.89999**2) * e[3]
    rows = [(1, e[0]), (2, at), (3, e[2]), (4, below), (5, 1e-200 * e[0]), (6, 1e200 * e[2]), (7, e[0][:4]), (8, e[0][:4] * 3), (9, e[5]), (9, e[5])]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (4, 0, 4, True), (5, 2, 1, False), (6, 1, 3, False), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 9, True), (9, 1, 9, True)]


def test_embedding_dedup_without_vectors(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in embedding_dedup.near_duplicates(none).collect()] == [(1, 0, 1, True)]
    assert embedding_dedup.near_duplicates(none.limit(0)).count() == 0


def test_slabs_are_bounded_by_bytes(spark):
    """Long vectors go in smaller slabs, and are linked as ever."""
    assert all(embedding_dedup.slab_of(d) * d * 8 <= embedding_dedup.SLAB_BYTES for d in (3, 64, 1024, 20_000)) and embedding_dedup.slab_of(64) == 32_768
    rng = np.random.RandomState(1)
    x = np.repeat(rng.standard_normal((700, 1024)), 4, 0) + rng.standard_normal((2800, 1024)) * 0.1
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert len(x) > embedding_dedup.slab_of(1024)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: (3, i // 4 * 4) for i in range(2800)}


def test_jaccard_frequent_keys(spark, monkeypatch):
    """Short texts that share a line: keys of most classes, dealt by class and key, with the same result."""
    monkeypatch.setattr(ngram_jaccard, "SEEN", 1)
    r = random.Random(12)
    line = "this text is licensed to all who read it"
    rows = [(i, f"{line} {r.choice('abcdefgh')} {r.choice('ijklmnop')} {r.randrange(6)}" + " z" * r.randrange(3)) for i in range(400)] + [(1000 + i, " ".join(f"{i}w{k}" for k in range(20))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets_of = ngram_jaccard._sets(ngram_jaccard._named(docs, "doc_id", "text"), "doc_id", "text", 4, ngram_jaccard.Scheme((85, 100)))
    made = sets_of.select("cls", F.explode("keys").alias("k"))
    often = {x.k for x in ngram_jaccard._frequent(made, 4).collect()}
    assert 0 < len(often) <= ngram_jaccard.HOT * 4
    own = {i: sets(t, 4) for i, t in rows}
    links = [(a, b) for a in own for b in own if a < b and 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])]
    want = union(own, links)
    assert {x.doc_id: x.component_id for x in ngram_jaccard.linked(docs).collect()} == want and len(set(want.values())) < 400
    hot = {tuple(x) for x in ngram_jaccard._groups(sets_of).collect()}
    monkeypatch.setattr(ngram_jaccard, "_frequent", lambda made, parts: made.select("k").limit(0))
    assert hot == {tuple(x) for x in ngram_jaccard._groups(sets_of).collect()}


def test_jaccard_of_long_sets(spark, monkeypatch):
    """Groups of large bitmaps are cut by bytes, long words are not remembered, and no link is lost."""
    monkeypatch.setattr(ngram_jaccard, "GROUP_BYTES", 1 << 13)
    r = random.Random(13)
    base = [f"w{r.randrange(10**6)}" for _ in range(6000)]
    rows = []
    for i in range(12):
        copy = list(base)
        for _ in range(20):
            copy[r.randrange(len(copy))] = f"x{i}"
        rows.append((i, " ".join(copy)))
    long = [str(k) + "q" * 400_000 for k in range(30)]
    rows += [(100, " ".join(long)), (101, " ".join(long + ["end"])), (102, " ".join(long[:15]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = {i: sets(t, 4) for i, t in rows}
    links = [(a, b) for a in own for b in own if a < b and 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])]
    assert {x.doc_id: x.component_id for x in ngram_jaccard.linked(docs).collect()} == union(own, links)
    ngram_jaccard.word_hashes(" ".join(long))
    assert sum(map(len, ngram_jaccard._words)) < 1_000_000
