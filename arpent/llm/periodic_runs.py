"""Stretches of words that repeat themselves, found in a suffix tree.

A run is a stretch of consecutive words of smallest period q - words q apart are identical - that is at least LEAST and
at least 2 * q words long and that no neighbouring word extends keeping the period.

The words of a batch of texts become numbers. Words that cannot lie in a run cut a text into segments: those of which no
like one stands within half a segment's length. What is left gets one suffix tree, a subtree for each segment, read off
a suffix array by prefix doubling and its longest common prefixes. At each inner node all leaves but those of its
largest child are visited (Stoye and Gusfield): a leaf i at a node of depth d begins or ends a branching tandem repeat
if i + d or i - d is a leaf of that node and the words after the two copies differ. Each such repeat is rotated to the left
as far as its words allow, which gives the one run of its period that ends there; repeats of a multiple of that period are
merged into it.

Texts stay in their partitions, nothing is shuffled. A worker holds one slice of a batch, at least one text, and for it
four bytes a word for each doubling up to the longest repetition.

Defined results: null and empty texts have no words and no runs; texts of every length are searched whole; equal texts
have equal runs; repeated ids are rows of their own; other columns are not looked at; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arpent.llm.bpe import slices
from arpent.llm.common import frugal

#: Words of the shortest run.
LEAST = 12
#: Passes over the words that look for cuts; each leaves fewer to the tree, none changes a result.
PASSES = 6
#: Leaves that are visited at once.
AT_ONCE = 1_000_000
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _sorted(key: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of keys from 0 to top, and the keys in it."""
    bits = int(len(key)).bit_length()
    if int(top).bit_length() + bits < 63:
        packed = np.sort(key << bits | np.arange(len(key)))
        return packed & ((1 << bits) - 1), packed >> bits
    order = np.argsort(key, kind="stable")
    return order, key[order]


def _segments(code: np.ndarray, segment: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that may lie in a run, and the segment of each: stretches of consecutive places."""
    place, top = np.arange(len(code)), int(code.max(initial=0)) + 1
    for _ in range(PASSES):
        size = np.bincount(segment) if len(segment) else np.zeros(0, np.int64)
        order, key = _sorted(segment * top + code, (int(segment.max(initial=0)) + 1) * top)
        gap = np.where(key[1:] == key[:-1], np.diff(order), len(code) + 1)
        near = np.full(len(code), len(code) + 1)
        near[order[1:]] = gap
        near[order[:-1]] = np.minimum(near[order[:-1]], gap)
        may = (near <= size[segment] // 2) & (size[segment] >= least)
        if may.all():
            break
        first = may.copy()
        first[1:] &= ~may[:-1] | (segment[1:] != segment[:-1])
        segment = (np.cumsum(first) - 1)[may]
        place, code = place[may], code[may]
    size = np.bincount(segment) if len(segment) else np.zeros(0, np.int64)
    long = size[segment] >= least
    return place[long], segment[long]


def _suffixes(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, ranks in it, and the common prefix of each suffix with the one before it; first: a number from 1 on
    for each word, different in different segments; end: where each place's segment ends."""
    n, at = len(first), np.arange(len(first))
    levels, rank, step = [first.astype(np.int32)], first, 1
    while True:
        ahead = at + step
        second = np.where(ahead < end, rank[np.minimum(ahead, n - 1)], 0)
        order, key = _sorted(rank * (n + 1) + second, (n + 1) ** 2)
        new = np.ones(n, np.int64)
        new[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        step *= 2
        if new.all():
            break
        levels.append(rank.astype(np.int32))
    common = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = (a < end[order[:-1]]) & (b < end[order[1:]])
        same &= levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
        move = same.astype(np.int64) << k
        a, b = a + move, b + move
    common[1:] = a - order[:-1]
    return order, rank - 1, common


def _nodes(common: np.ndarray) -> np.ndarray:
    """A row for each inner node but the root: depth, its leaves [left, right), and those of its largest child."""
    out: list[tuple[int, int, int, int, int]] = []
    packed = [np.zeros((0, 5), np.int64)]
    depth, left, child, big, big_end = [0], [0], [0], [0], [0]
    for i, c in enumerate(chain(common[1:].tolist(), (0,)), 1):
        since, d = i - 1, depth[-1]
        while d > c:
            since, last, lo, hi = left.pop(), child.pop(), big.pop(), big_end.pop()
            out.append((d, since, i, last, i) if i - last > hi - lo else (d, since, i, lo, hi))
            depth.pop()
            d = depth[-1]
        if len(out) > 100_000:
            packed.append(np.array(out, np.int64))
            out.clear()
        if d < c:
            depth.append(c)
            left.append(since)
            child.append(i)
            big.append(since)
            big_end.append(i)
        elif c:
            if i - child[-1] > big_end[-1] - big[-1]:
                big[-1], big_end[-1] = child[-1], i
            child[-1] = i
    return np.concatenate([*packed, np.array(out, np.int64).reshape(-1, 5)])


def _branching(first: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and periods of all branching tandem repeats, each once, by end and period."""
    order, rank, common = _suffixes(first, end)
    nodes = _nodes(common)
    n, found = len(first), []
    sizes = (nodes[:, 3] - nodes[:, 1]) + (nodes[:, 2] - nodes[:, 4])  # leaves outside the largest child
    part = np.cumsum(sizes) // AT_ONCE
    for block in np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(part)) + 1):
        if not len(block):
            continue
        of = np.repeat(block, sizes[block])
        within = np.arange(len(of)) - np.repeat(np.cumsum(sizes[block]) - sizes[block], sizes[block])
        d, lo, hi, big, big_end = nodes[of].T
        leaf = lo + within
        i = order[np.where(leaf < big, leaf, leaf - big + big_end)]
        for start in (i, i - d):  # the leaf begins the first copy, or the second one
            other = np.where(start == i, i + d, start)
            inside = (other >= begin[i]) & (other < end[i])
            where = rank[np.clip(other, 0, n - 1)]
            is_repeat = np.flatnonzero(inside & (where >= lo) & (where < hi))
            s, q = start[is_repeat], d[is_repeat]
            after = s + 2 * q
            differs = (after == end[s]) | (first[np.minimum(after, n - 1)] != first[s + q])
            found.append(after[differs] * (n + 1) + q[differs])
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys // (n + 1), keys % (n + 1)


def _rotated(first: np.ndarray, begin: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Each start moved to the left while the word before it equals the one a period later."""
    start, open_ = start.copy(), np.arange(len(start))
    for _ in range(64):
        s = start[open_]
        open_ = open_[(s > begin[s]) & (first[s - 1] == first[s - 1 + period[open_]])]
        start[open_] -= 1
        if not len(open_):
            return start
    for k in open_.tolist():  # long runs, block by block
        s, q, least, block = int(start[k]), int(period[k]), int(begin[start[k]]), 256
        while s > least:
            lo = max(least, s - block)
            differ = np.flatnonzero(first[lo:s] != first[lo + q : s + q])
            if len(differ):
                s = lo + int(differ[-1]) + 1
                break
            s, block = lo, 2 * block
        start[k] = s
    return start


def find_runs(code: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period. code: the words of all texts as numbers
    from 0 on; sizes: the number of words of each text."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    place, segment = _segments(code.astype(np.int64), text, least)
    if not len(place):
        return np.zeros((0, 4), np.int64)
    top = int(code.max()) + 1
    segment = np.unique(segment, return_inverse=True)[1]
    order, key = _sorted(segment * top + code[place], (int(segment[-1]) + 1) * top)
    first = np.empty(len(place), np.int64)
    first[order] = np.cumsum(np.append(True, key[1:] != key[:-1]))
    cuts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    begin, end = cuts[segment], np.append(cuts[1:], len(place))[segment]
    ends, periods = _branching(first, begin, end)
    runs = []
    while len(ends):  # of the repeats that end at one place, the shortest period, then what is no multiple of it
        lead = np.append(True, ends[1:] != ends[:-1])
        e, q = ends[lead], periods[lead]
        s = _rotated(first, begin, e - 2 * q, q)
        runs.append(np.stack([s, e - s, q], 1))
        of = np.cumsum(lead) - 1
        merged = (periods % q[of] == 0) & (ends - 2 * periods >= s[of])
        ends, periods = ends[~merged], periods[~merged]
    runs = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    runs = runs[runs[:, 1] >= least]
    at = place[runs[:, 0]]
    of = text[at]
    out = np.stack([of, at - (np.cumsum(sizes) - sizes)[of], runs[:, 1], runs[:, 2]], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, and how many words each has."""
    number = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum())), sizes


def with_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """A row for each document: key, n_words, runs by start and period, and `collapsed`: the words, a blank apart, without
    those that a run contains after its first period."""

    def run(batches):
        for batch in slices(batches, text):
            words = [(x or b"").split() for x in batch.column(text).cast(pa.binary()).to_pylist()]
            found = find_runs(*numbered(words), least)
            spans: dict[int, list] = {}
            for of, start, length, period in found.tolist():
                spans.setdefault(of, []).append({"start": start, "length": length, "period": period})
            kept = []
            for k, own in enumerate(words):
                if k in spans:
                    gone = np.zeros(len(own) + 1, np.int64)
                    for r in spans[k]:
                        gone[r["start"] + r["period"]] += 1
                        gone[r["start"] + r["length"]] -= 1
                    own = [own[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                kept.append(b" ".join(own))
            arrays = [batch.column(key), pa.array([len(w) for w in words], pa.int64()), pa.array([spans.get(k, []) for k in range(len(words))], kind), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "n_words", "runs", "collapsed"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string"
    return docs.select(key, text).mapInArrow(frugal(run), schema)


def with_planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and text, where one id in ten, by its checksum, has its words repeated periodically from some word on."""
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    n, g = F.size("_words"), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    docs = docs.select(F.col(key), F.col(text), words.alias("_words"))
    docs = docs.select(key, text, "_words", F.when(n > 0, F.struct(n.alias("n"), a.alias("a"), p.alias("p"))).alias("_at"))
    head, period = F.slice("_words", F.lit(1), F.col("_at.a")), F.slice("_words", F.col("_at.a") + 1, F.col("_at.p"))
    times = F.ceil((F.col("_at.n") - F.col("_at.a")) / F.col("_at.p")).cast("int")
    planted = F.slice(F.concat(head, F.flatten(F.array_repeat(period, times))), F.lit(1), F.col("_at.n"))
    return docs.select(key, F.when(F.col("_at").isNotNull(), F.array_join(planted, " ")).otherwise(F.col(text)).alias(text))


def _longest(runs: Column) -> Column:
    """The run of greatest length, of these of the smallest start and then period; null without runs."""
    better = lambda a, b: (b["length"] > a["length"]) | (b["length"] == a["length"]) & ((b["start"] < a["start"]) | (b["start"] == a["start"]) & (b["period"] < a["period"]))
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))


def summarized(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """For each document the number of its runs, its longest run, and digests of all runs and of the collapsed text."""
    found = with_runs(docs, key, text, least).withColumn("r", _longest(F.col("runs")))
    line = lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        key, F.size("runs").cast("long").alias("n_runs"), "r.start", "r.length", "r.period", F.floor(1000 * F.col("r.length") / F.col("r.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
