"""Scoring text by a hierarchical Pitman-Yor model with Chinese-restaurant seating sampled by Gibbs.

Restaurants: every token eats in the restaurant of its context, the class of the word before it; FINE such classes - so
many that a frequent word mostly has one with rare words alone - share COARSE parents by the ends of those words, and
these share the root, whose base is uniform over the training words and one unknown. Each table of a restaurant is a
customer of its parent.

The corpus is dealt by word. All customers of one word, in all restaurants, lie in one partition's state; only the
restaurants' totals of customers and tables, FINE + COARSE + 1 pairs of numbers, go through the driver. A sweep reseats
every dish of every restaurant given the totals of the sweep before: the number of tables is drawn from its exact
conditional, by generalized Stirling numbers, for dishes of up to EXACT customers, and by seating in growing blocks
beyond. What is drawn for a dish depends on its word, its restaurant and the sweep, not on how the words are dealt. Discounts come from the counts of ones and twos on each level; after each sweep the concentrations of the three
levels are drawn on a grid given the totals of all restaurants. After `burn_in` sweeps the predictive probabilities
of `samples` sweeps are averaged.

Two passes read the texts. The first counts words and contexts in each task before they are dealt. The second deals the
tokens of all documents to the words' states, packed by task and partition, and adds the logarithms up by document.
Words of more than a partition's share of all tokens, the HOT_WORDS most frequent at most, are scored where the text is
read, from a table that is broadcast, so that no frequent word gathers in one task.

Defined results: null and empty texts are the end token alone; repeated rows are each scored, and learned from, on their
own; a null id counts as the empty text in the choice of held-out rows; without training rows the model is the uniform
base over one unknown token; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arpent.llm.bpe import slices
from arpent.llm.common import drop, frugal, mix64, stored

#: Context classes and their parents; the class of a word is kept in the low bits of its hash.
BITS, COARSE = 17, 64
FINE = 1 << BITS
PER_COARSE = FINE // COARSE
BURN_IN, SAMPLES, EXACT = 1, 2, 256
#: The concentrations that are drawn from.
STRENGTHS = np.geomspace(0.1, 1e6, 57)
ADD = 0.1
#: Tokens that are packed together, and documents at most.
TOKENS_AT_ONCE, DOCS_AT_ONCE = 1_000_000, 20_000
#: Bytes of text whose words are hashed together.
PART = 1 << 20
HOT_WORDS = 16
#: Numbers of a block of dishes that are drawn together.
DRAWN = 2_400_000


def pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _finished(sums: np.ndarray, sizes: np.ndarray, last: np.ndarray, last_but_one: np.ndarray) -> np.ndarray:
    """47 bits of each word's hash, then its context class: six bits of a hash of its last two bytes and the rest of its own."""
    own = mix64(sums ^ mix64(sizes.astype(np.uint64)))
    ends = mix64(last.astype(np.uint64) << np.uint64(8) | last_but_one | np.uint64(1 << 20)) % np.uint64(COARSE)
    return (own & ~np.uint64(FINE - 1)) | ends * np.uint64(PER_COARSE) | (own % np.uint64(PER_COARSE))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte's place of each word: sums of its bytes, A-Z lower-cased, by powers of an odd number."""
    raw = np.frombuffer(data, np.uint8)
    gap = (raw == 32) | ((raw - np.uint8(9)) < 5)
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    low = raw + ((raw - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)
    size = end - start
    power = np.cumprod(np.full(int(size.max()), MULTIPLIER, np.uint64))
    within = np.arange(int(size.sum()), dtype=np.int64)
    first = np.cumsum(size) - size
    within -= np.repeat(first, size)
    sums = np.add.reduceat(low[~gap] * power[within], first)
    before = np.where(size > 1, low[np.maximum(end - 2, 0)], 0)
    return _finished(sums, size, low[end - 1], before), start


def _hash(word: bytes) -> int:
    return int(_words(word)[0][0]) if word else int(END)


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
END = _finished(*(np.zeros(1, np.uint64),) * 4)[0]
_gap = re.compile(rb"[ \t-\r]")


def _parts(raw: bytes) -> list[bytes]:
    """A text in parts of about PART bytes, cut where words end."""
    out, since = [], 0
    while len(raw) - since > PART and (cut := _gap.search(raw, since + PART)):
        out.append(raw[since : cut.start()])
        since = cut.start()
    return [*out, raw[since:]]


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, an end after each text, and the number of tokens of each text."""
    out, sizes, held, ends, n = [], [], [], [], 0

    def flush() -> None:
        nonlocal n
        h, start = _words(b"".join(held))
        of = np.searchsorted(np.array(ends), start, "right")
        words = np.bincount(of, minlength=len(ends))[: len(ends)]
        found = np.full(len(h) + len(ends), END, np.uint64)
        found[np.arange(len(h)) + of] = h
        out.append(found)
        sizes.append(words + 1)
        held.clear()
        ends.clear()
        n = 0

    for text in texts:
        *first, last = _parts((text or "").encode("utf-8", "surrogatepass"))
        if first:
            flush()
            found = [_words(p)[0] for p in first] + [_words(last)[0], np.array([END])]
            out.append(np.concatenate(found))
            sizes.append(np.array([len(out[-1])]))
            continue
        held.append(last + b"\n")
        n += len(last) + 1
        ends.append(n)
        if n >= PART:
            flush()
    flush()
    return np.concatenate(out), np.concatenate(sizes).astype(np.int64)


def contexts(h: np.ndarray) -> np.ndarray:
    """The class of the token before each; before the first of a text stands the end of another."""
    before = np.empty_like(h)
    before[:1], before[1:] = np.uint64(END), h[:-1]
    return (before & np.uint64(FINE - 1)).astype(np.int64)


def held_out(key) -> bool:
    return zlib.crc32(b"" if key is None else str(key).encode()) % 10 == 0


def partition_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each word: ranges of its hash, so that words in order are in order of partitions too."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _ordered(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The order by hash, then context; by two sorts of single numbers where they have room for all."""
    bits = len(h).bit_length()
    if 2 * bits + BITS > 63:
        return np.lexsort((c, h))
    first = np.argsort(h)
    sorted_h = h[first]
    word = np.cumsum(np.append(False, sorted_h[1:] != sorted_h[:-1])) if len(h) else first
    key = np.sort(((word << BITS | c[first].astype(np.int64)) << bits) | first)
    return key & ((1 << bits) - 1)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _by_size(batches, key: str, text: str):
    """Keys, hashes, contexts and sizes of about TOKENS_AT_ONCE tokens at once."""
    keys, hs, sizes, n = [], [], [], 0
    for part in slices(batches, text, 1_000_000):
        h, size = tokens(part.column(text).to_pylist())
        keys += part.column(key).to_pylist()
        hs.append(h)
        sizes.append(size)
        n += len(h)
        if n >= TOKENS_AT_ONCE or len(keys) >= DOCS_AT_ONCE:
            h = np.concatenate(hs)
            yield keys, h, contexts(h), np.concatenate(sizes)
            keys, hs, sizes, n = [], [], [], 0
    if keys:
        h = np.concatenate(hs)
        yield keys, h, contexts(h), np.concatenate(sizes)


def _cut(parts: np.ndarray) -> list[tuple[int, int, int]]:
    """(partition, first, last) of the runs in a sorted column."""
    at = _starts(parts)
    return list(zip(parts[at].tolist(), at.tolist(), [*at[1:].tolist(), len(parts)][: len(at)], strict=True))


def counted(docs: DataFrame, parts: int, key: str, text: str) -> DataFrame:
    """part, data: (hashes, contexts, counts) of the training tokens, summed up in each task's batches."""

    def run(batches):
        for keys, h, c, sizes in _by_size(batches, key, text):
            learn = np.repeat(~np.array([held_out(k) for k in keys]), sizes)
            h, c = h[learn], c[learn]
            order = _ordered(h, c)
            h, c = h[order], c[order]
            at = _starts(h, c)
            n = np.diff(np.append(at, len(h)))
            h, c = h[at], c[at].astype(np.uint32)
            cuts = _cut(partition_of(h, parts))
            blobs = []
            for _, lo, hi in cuts:
                first = _starts(h[lo:hi])
                blobs.append(pack(h[lo:hi][first], np.diff(np.append(first, hi - lo)).astype(np.int32), c[lo:hi], n[lo:hi].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in cuts], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "data"])

    return docs.select(key, text).mapInArrow(frugal(run), "part int, data binary")


class State:
    """The seating of one partition's words. words and counts of contexts are fixed; tables are sampled."""

    def __init__(self, words, per_word, ctx, count, tables=None, coarse_tables=None, root_tables=None, samples=()):
        self.words, self.per_word, self.ctx, self.count = words, per_word, ctx, count
        self.word = np.repeat(np.arange(len(words)), per_word)
        coarse = ctx.astype(np.int64) // PER_COARSE
        self.coarse_at = _starts(self.word, coarse)
        self.coarse, self.coarse_word = coarse[self.coarse_at], self.word[self.coarse_at]
        self.word_at, self.root_at = _starts(self.word), _starts(self.coarse_word)
        self.tables = np.ones(len(ctx), np.int64) if tables is None else tables
        self.coarse_tables = np.ones(len(self.coarse), np.int64) if coarse_tables is None else coarse_tables
        self.root_tables = np.ones(len(words), np.int64) if root_tables is None else root_tables
        self.samples = list(samples)

    @staticmethod
    def merged(blobs: list[bytes]) -> "State":
        found = [unpack(b) for b in blobs]
        h = np.concatenate([np.repeat(w, k) for w, k, _, _ in found]) if found else np.zeros(0, np.uint64)
        c = np.concatenate([x[2] for x in found]) if found else np.zeros(0, np.uint32)
        n = np.concatenate([x[3] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64)
        order = _ordered(h, c)
        h, c, n = h[order], c[order], n[order]
        at = _starts(h, c)
        n = np.add.reduceat(n, at) if len(at) else n
        h, c = h[at], c[at]
        first = _starts(h)
        return State(h[first], np.diff(np.append(first, len(h))), c, n)

    def pack(self) -> bytes:
        small = lambda x: x.astype(np.int32)
        return pack(self.words, small(self.per_word), self.ctx, small(self.count), small(self.tables), small(self.coarse_tables), small(self.root_tables), self.samples)

    @staticmethod
    def unpack(data: bytes) -> "State":
        words, per_word, ctx, count, tables, coarse, root, samples = unpack(data)
        return State(words, per_word, ctx, count.astype(np.int64), tables.astype(np.int64), coarse.astype(np.int64), root.astype(np.int64), samples)

    @property
    def coarse_count(self) -> np.ndarray:
        return np.add.reduceat(self.tables, self.coarse_at) if len(self.coarse_at) else np.zeros(0, np.int64)

    @property
    def root_count(self) -> np.ndarray:
        return np.add.reduceat(self.coarse_tables, self.root_at) if len(self.root_at) else np.zeros(0, np.int64)

    def word_count(self) -> np.ndarray:
        return np.add.reduceat(self.count, self.word_at) if len(self.word_at) else np.zeros(0, np.int64)

    def totals(self) -> np.ndarray:
        """Customers and tables of all restaurants, then tokens, words and the ones and twos of each level."""
        total = lambda at, x, n: np.bincount(at, weights=x, minlength=n)
        cc, rc = self.coarse_count, self.root_count
        ones = [(x == k).sum() for x in (rc, cc, self.count) for k in (1, 2)]
        return np.concatenate([
            total(self.ctx, self.count, FINE), total(self.ctx, self.tables, FINE), total(self.coarse, cc, COARSE),
            total(self.coarse, self.coarse_tables, COARSE), [rc.sum(), self.root_tables.sum(), self.count.sum(), len(self.words)], ones,
        ]).astype(np.float64)

    def probabilities(self, t: "Totals") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The predictive probability of each word at the root, in its parents' and in its contexts' restaurants."""
        root = (self.root_count - t.d[0] * self.root_tables + t.open_root * t.base) / (t.s[0] + t.root[0])
        up = root[self.coarse_word]
        coarse = (self.coarse_count - t.d[1] * self.coarse_tables + t.open_coarse[self.coarse] * up) / (t.s[1] + t.coarse[0][self.coarse])
        up = np.repeat(coarse, np.diff(np.append(self.coarse_at, len(self.ctx))))
        fine = (self.count - t.d[2] * self.tables + t.open_fine[self.ctx] * up) / (t.s[2] + t.fine[0][self.ctx])
        return root, coarse, fine

    def sweep(self, t: "Totals", seed: int) -> None:
        """Reseat all dishes from the contexts up to the root."""
        root, coarse, _ = self.probabilities(t)
        up = np.repeat(coarse, np.diff(np.append(self.coarse_at, len(self.ctx))))
        dish = lambda word, restaurant: mix64(self.words[word] ^ mix64(restaurant.astype(np.uint64) + np.uint64(seed << 32)))
        every = np.arange(len(self.words))
        self.tables = draw_tables(self.count, self.tables, t.fine[1][self.ctx], up, t.d[2], t.s[2], dish(self.word, self.ctx))
        self.coarse_tables = draw_tables(self.coarse_count, self.coarse_tables, t.coarse[1][self.coarse], root[self.coarse_word], t.d[1], t.s[1], dish(self.coarse_word, FINE + self.coarse))
        self.root_tables = draw_tables(self.root_count, self.root_tables, np.full(len(self.words), t.root[1]), np.full(len(self.words), t.base), t.d[0], t.s[0], dish(every, np.full(len(every), FINE + COARSE)))

    def keep_sample(self) -> None:
        self.samples.append((self.tables[self.count > 1].astype(np.int32), self.coarse_tables.astype(np.int32), self.root_tables.astype(np.int32)))

    def at_sample(self, k: int) -> "State":
        tables, coarse, root = self.samples[k]
        full = np.ones(len(self.ctx), np.int64)
        full[self.count > 1] = tables
        return State(self.words, self.per_word, self.ctx, self.count, full, coarse.astype(np.int64), root.astype(np.int64))


class Totals:
    """What the restaurants of all partitions hold together."""

    def __init__(self, x: np.ndarray):
        f, c = FINE, COARSE
        self.raw, self.fine, self.coarse = x, (x[:f], x[f : 2 * f]), (x[2 * f : 2 * f + c], x[2 * f + c : 2 * f + 2 * c])
        rest = x[2 * f + 2 * c :]
        self.root, self.n, self.v = (float(rest[0]), float(rest[1])), int(rest[2]), int(rest[3])
        self.base = 1 / (self.v + 1)
        self.d = [float(np.clip(a / max(a + 2 * b, 1), 0.05, 0.95)) for a, b in rest[4:].reshape(3, 2)]
        self.with_discounts(self.d, np.random.default_rng(0))

    def with_discounts(self, d: list[float], rng: np.random.Generator) -> "Totals":
        """These totals with given discounts, and with concentrations drawn given both."""
        self.d = d
        levels = [(np.array([self.root[0]]), np.array([self.root[1]])), self.coarse, self.fine]
        self.s = [draw_strength(c, t, x, rng) for (c, t), x in zip(levels, d, strict=True)]
        self.open_root = self.s[0] + d[0] * self.root[1]
        self.open_coarse = self.s[1] + d[1] * self.coarse[1]
        self.open_fine = self.s[2] + d[2] * self.fine[1]
        return self

    def back_off(self) -> tuple[np.ndarray, np.ndarray]:
        """The share that a context leaves to its parent, and each parent to the root."""
        return self.open_fine / (self.s[2] + self.fine[0]), self.open_coarse / (self.s[1] + self.coarse[0])


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def draw_strength(customers: np.ndarray, tables: np.ndarray, d: float, rng: np.random.Generator) -> float:
    """A concentration for restaurants of these totals, from its conditional on the grid."""
    some = customers > 0
    g = lambda x: _lgamma(x).astype(float)
    n, s = int(some.sum()), STRENGTHS[None, :]
    log = n * (g(STRENGTHS + 1) - g(STRENGTHS / d + 1))
    for total, first, sign in ((tables[some], s / d, 1), (customers[some], s, -1)):  # few totals differ
        value, times = np.unique(total, return_counts=True)
        log = log + sign * (times[:, None] * g(first + value[:, None])).sum(0)
    return float(STRENGTHS[int((log + rng.gumbel(size=len(STRENGTHS))).argmax())])


_stirling: dict[float, np.ndarray] = {}


def stirling(d: float) -> np.ndarray:
    """Logarithms of the generalized Stirling numbers of discount d for up to EXACT customers and tables."""
    if d not in _stirling:
        s = np.full((EXACT + 1, EXACT + 1), -np.inf)
        s[1, 1], m = 0, np.arange(EXACT + 1)
        for n in range(1, EXACT):
            stay = s[n] + np.log(np.maximum(n - m * d, 1e-300))
            s[n + 1, 1:] = np.logaddexp(s[n, :-1], stay[1:])
        _stirling[d] = s
    return _stirling[d]


def uniform(dish: np.ndarray, n: int) -> np.ndarray:
    """n numbers between 0 and 1 for each dish, of its own and without a generator's state."""
    bits = mix64(dish[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def draw_tables(count, tables, total_tables, up, d, strength, dish) -> np.ndarray:
    """The number of tables of each dish, drawn given its customers, the restaurant's other tables and the parent's
    probability of the dish."""
    out = np.minimum(count, 1)
    others = np.maximum(total_tables - tables, 0)
    log_up = np.log(np.maximum(up, 1e-300))
    s = stirling(d)
    exact = np.flatnonzero((count > 1) & (count <= EXACT))
    exact = exact[np.argsort(count[exact], kind="stable")]
    for n, lo, hi in _cut(count[exact]):
        step = max(1, DRAWN // n)
        for a in range(lo, hi, step):
            rows = exact[a : min(hi, a + step)]
            opening = np.log(strength + d * (others[rows, None] + np.arange(n)))
            weight = s[n, 1 : n + 1] + np.cumsum(opening + log_up[rows, None], 1)
            out[rows] = 1 + (weight - np.log(-np.log(uniform(dish[rows], n)))).argmax(1)
    many = np.flatnonzero(count > EXACT)
    for k in many.tolist():
        rng, n, t, seated = np.random.default_rng(int(dish[k])), int(count[k]), 1, 1
        while seated < n:
            block = min(max(seated // 8, 1), n - seated)
            new = (strength + d * (others[k] + t)) * up[k]
            t += int(rng.binomial(block, min(1.0, new / (new + max(seated - d * t, 1e-9)))))
            seated += block
        out[k] = t
    return out


def _totals(states: DataFrame) -> Totals:
    """The sum of all partitions' totals; 64 tasks add them up before the driver does."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpack(x.as_py())[0] for x in table.column("totals"))
        return pa.table({"totals": pa.array([pack(total)], pa.binary())})

    some = states.select("totals", F.pmod("part", F.lit(64)).alias("g")).groupBy("g").applyInArrow(add, "totals binary").collect()
    size = 2 * FINE + 2 * COARSE + 10
    return Totals(sum((unpack(r["totals"])[0] for r in some), np.zeros(size)))


def _row(part: int, state: State) -> pa.Table:
    return pa.table({"part": pa.array([part], pa.int32()), "data": pa.array([state.pack()], pa.binary()), "totals": pa.array([pack(state.totals())], pa.binary())})


STATE = "part int, data binary, totals binary"


def fit(docs: DataFrame, parts: int, key: str = "doc_id", text: str = "text", seed: int = 7, burn_in: int = BURN_IN, samples: int = SAMPLES) -> tuple[DataFrame, list[Totals]]:
    """The stored states with their samples, and the totals that belong to each sample."""
    gathered = counted(docs, parts, key, text).groupBy("part")
    states = stored(gathered.applyInArrow(lambda t: _row(t.column("part")[0].as_py(), State.merged(t.column("data").to_pylist())), STATE), "seating")
    totals = _totals(states)
    discounts, kept = totals.d, []
    for k in range(burn_in + samples):
        known, keep = totals, k >= burn_in

        def run(batches, known=known, keep=keep, k=k):
            for batch in batches:
                for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    state = State.unpack(data)
                    state.sweep(known, seed * 1000 + k)
                    if keep:
                        state.keep_sample()
                    yield from _row(part, state).to_batches()

        before, states = states, stored(states.mapInArrow(frugal(run), STATE), "seating")
        drop(before)
        totals = _totals(states).with_discounts(discounts, np.random.default_rng([seed, k]))
        if keep:
            kept.append(totals)
    return states, kept


def _hot(states: DataFrame, totals: list[Totals], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and log10 probabilities in all contexts of the words that have more than a partition's share of all
    tokens, the HOT_WORDS most frequent of them at most."""

    def often(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                count = State.unpack(data).word_count()
                top = count[count >= max(1, totals[0].n // parts)]
                yield pa.RecordBatch.from_arrays([pa.array(np.sort(top)[-HOT_WORDS:], pa.int64())], names=["n"])

    found = states.select("data").mapInArrow(frugal(often), "n long").orderBy(F.desc("n")).limit(HOT_WORDS).collect()
    least = min((r["n"] for r in found), default=totals[0].n + 1)

    def run(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                state = State.unpack(data)
                count = state.word_count()
                chosen = np.flatnonzero(count >= least)
                model = Model(state, totals) if len(chosen) else None
                for w in chosen:
                    p = model.log10(np.full(FINE, w), np.arange(FINE)).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([pack(model.state.words[w], count[w], p)], pa.binary())], names=["data"])

    found = sorted((unpack(r["data"]) for r in states.select("data").mapInArrow(frugal(run), "data binary").collect()), key=lambda x: x[0])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, FINE), np.float32)
    return np.array([x[0] for x in found], np.uint64), np.array([x[1] for x in found], np.int64), np.stack([x[2] for x in found])


class Model:
    """Averaged predictive probabilities of one partition's words."""

    def __init__(self, state: State, totals: list[Totals]):
        self.state, self.totals = state, totals
        self.at = [state.at_sample(k).probabilities(t) for k, t in enumerate(totals)]
        self.fine_key = state.word * FINE + state.ctx
        self.coarse_key = state.coarse_word * COARSE + state.coarse

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)

    def log10(self, word: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """log10 of the averaged probability of each word, by place or -1 for unknown ones, in each context."""
        known = word >= 0
        f_at, f_is = self._find(self.fine_key, word * FINE + ctx)
        c_at, c_is = self._find(self.coarse_key, word * COARSE + ctx // PER_COARSE)
        total = np.zeros(len(word))
        for (root, coarse, fine), t in zip(self.at, self.totals, strict=True):
            to_coarse, to_root = t.back_off()
            unknown = t.open_root * t.base / (t.s[0] + t.root[0])
            p = np.where(known, root[np.maximum(word, 0)], unknown) if len(root) else np.full(len(word), unknown)
            p = p * to_root[ctx // PER_COARSE]
            p[c_is] = coarse[c_at[c_is]]
            p = p * to_coarse[ctx]
            p[f_is] = fine[f_at[f_is]]
            total += p
        return np.log10(total / len(self.totals))


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias(key), text)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    states, totals = fit(docs, parts, key, text, burn_in=burn_in, samples=samples)
    n, v = totals[0].n, totals[0].v
    hot = spark.sparkContext.broadcast(_hot(states, totals, parts))
    shared = spark.sparkContext.broadcast(totals)

    def base(count):
        return np.log10((count + ADD) / (n + ADD * (v + 1)))

    def deal(batches):
        words, counts, logs = hot.value
        for k, (keys, h, c, sizes) in enumerate(_by_size(batches, key, text)):
            name = f"{TaskContext.get().partitionId()}-{k}"
            doc = np.repeat(np.arange(len(keys), dtype=np.int32), sizes)
            at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
            often = words[at] == h if len(words) else np.zeros(len(h), bool)
            a, d = at[often], doc[often]
            add = lambda x: np.bincount(d, weights=x, minlength=len(keys))  # noqa: E731, B023
            own = (add(logs[a, c[often]]), add(base(counts[a])), add(np.ones(len(a)))) if len(words) else (np.zeros(len(keys)),) * 3
            out = [(-1, name, 0, pack(keys, sizes, *own))]
            h, c, doc = h[~often], c[~often], doc[~often]
            order = _ordered(h, c)
            h, c, doc = h[order], c[order].astype(np.uint32), doc[order]
            for p, lo, hi in _cut(partition_of(h, parts)):
                first = _starts(h[lo:hi])
                out.append((p, name, 2, pack(h[lo:hi][first], np.diff(np.append(first, hi - lo)).astype(np.int32), c[lo:hi], doc[lo:hi], len(keys))))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(cols, (pa.int32(), pa.string(), pa.int32(), pa.binary()), strict=True)], names=["part", "batch", "kind", "data"])

    def look_up(batches):
        model, own, count = None, None, None
        for batch in batches:
            for part, name, kind, data in zip(*(batch.column(x).to_pylist() for x in ("part", "batch", "kind", "data")), strict=True):
                if kind == 1:
                    model, own = Model(State.unpack(data), shared.value), part
                    count = model.state.word_count()
                    continue
                if kind == 2:
                    if own != part:
                        model, own = Model(State(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64), samples=[(np.zeros(0, np.int32),) * 3] * len(shared.value)), shared.value), part
                        count = np.zeros(0, np.int64)
                    words, per_word, c, doc, docs_in = unpack(data)
                    at = np.minimum(np.searchsorted(model.state.words, words), max(len(model.state.words) - 1, 0))
                    known = model.state.words[at] == words if len(model.state.words) else np.zeros(len(words), bool)
                    place = np.where(known, at, -1)
                    bases = base(np.where(known, count[at], 0) if len(count) else np.zeros(len(words)))
                    word, c = np.repeat(np.arange(len(words)), per_word), c.astype(np.int64)
                    first = _starts(word, c)
                    log = np.repeat(model.log10(place[word[first]], c[first]), np.diff(np.append(first, len(c))))
                    add = lambda x: np.bincount(doc, weights=x, minlength=docs_in)  # noqa: E731, B023
                    data = pack(add(log), add(bases[word]), add(known[word].astype(float)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], names=["batch", "kind", "data"])

    def add_up(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True))
        keys, sizes, *sums = unpack(next(d for k, d in rows if k == 0))
        for kind, data in sorted(rows):
            if kind == 2:
                sums = [a + b for a, b in zip(sums, unpack(data), strict=True)]
        return pa.table({
            key: pa.array(keys, pa.int64()), "held_out": pa.array([held_out(k) for k in keys]), "n_tokens": sizes,
            "n_known": np.rint(sums[2]).astype(np.int64), "train_tokens": np.full(len(keys), n), "base_score": sums[1], "score": sums[0],
        })

    dealt = docs.mapInArrow(frugal(deal), "part int, batch string, kind int, data binary")
    models = states.select("part", F.lit("").alias("batch"), F.lit(1).alias("kind"), "data")
    met = dealt.unionByName(models).repartition(parts, F.when(F.col("part") >= 0, F.col("part").cast("string")).otherwise(F.col("batch")))
    looked_up = met.sortWithinPartitions("part", "kind").mapInArrow(frugal(look_up), "batch string, kind int, data binary")
    return looked_up.groupBy("batch").applyInArrow(add_up, f"{key} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
