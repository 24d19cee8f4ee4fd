"""N-gram Jaccard join of whole documents: components of documents whose sets of word shingles are alike.

1. Every document becomes its set of hashed shingles. Documents of equal sets are one class; only classes are compared.
2. Candidates by exact pigeonhole. Sets in octaves of size are cut into segments by the hash of the shingle. Two linked
   sets differ in at most d elements, so of any d + 1 segments of one set at least one equals the other's. A set makes keys
   of its first d + 1 segments of two elements or more, and of all its segments where it has too few of those. Small sets
   and sets with fewer than d + 1 segments use a prefix of their sorted hashes, of the length that linked sets share a
   hash in. Classes that share a key are a group; equal groups are one.
3. Groups are compared in tiles of hashed bitmaps: sets of like size, where the number of differing bits bounds the overlap
   from above. In a group of more than GROUP classes, or with large bitmaps, a tile holds two chunks of a band of size or
   of two bands side by side, of GROUP_BYTES each at most. What the bound lets pass joins clusters; only the clusters' texts are read again.
4. Clusters are verified in tiles of texts, of about TILE shingles a chunk: where the bitmaps allow a link, the sorted
   hashes are intersected exactly. Pairs that links have already joined need no comparison.
5. Links make components; the component's name is its smallest document id.

No link is lost: all filters are exact bounds, whatever the hashes. Shingles are compared as 64-bit hashes.

Defined results: null and empty texts and those of white space alone have no shingles and link with nothing; a text of
fewer words than a shingle is one shingle; equal texts are linked; repeated ids fall into the same component only by
their texts; null ids never name a component unless all its ids are null; an empty table gives an empty result; other
columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arpent.llm.bpe import slices, spans, text_bytes
from arpent.llm.common import LONG_WORD, Memo, drop, free_name, frugal, mix64, stored
from arpent.llm.graph import components

#: Words of a shingle and least similarity as a fraction of whole numbers.
WORDS, LEAST = 4, (85, 100)
#: Sets of fewer shingles use prefix keys alone.
SMALL = 32
#: Classes of a chunk whose bitmaps are compared together, and bytes of these; shingles and classes of a chunk that is verified.
GROUP, GROUP_BYTES, TILE, VERIFIED = 4096, 1 << 25, 1 << 20, 1024
#: Of the classes, by hash, one in SEEN tells which keys are frequent: those that hold a HOT-th of a partition's share or more.
SEEN, HOT = 64, 4
#: Bytes of text that are sent to tiles at a time.
PLACED = 4_000_000
REMEMBERED = 250_000
_words = Memo(REMEMBERED)
_P = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word; A-Z are lower-cased, and words stand between blanks and ASCII controls 9 to 13."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    _words.room(len(words))
    get, out = _words.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            if len(w) <= LONG_WORD:
                _words[w] = h
        out.append(h)
    return np.array(out, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    size = min(words, len(h))
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix64(out * _P + h[k : k + n])
    return np.unique(out)


def set_hash(s: np.ndarray) -> int:
    """One signed 64-bit hash of a whole set."""
    total = np.array([mix64(s).sum(dtype=np.uint64), len(s)], np.uint64)
    return int(mix64(total[:1] ^ mix64(total[1:] * _P)).view(np.int64)[0])


def octave(n: int) -> int:
    return n.bit_length() - 1


class Scheme:
    """What the least similarity p / q says of sizes and differences."""

    def __init__(self, least: tuple[int, int]):
        self.p, self.q = p, q = least
        if 2 * p < q:
            raise ValueError("similarities below one half are not joined: sizes may differ by more than an octave")
        starts = [1]
        while starts[-1] < 1 << 40:
            starts.append(max(starts[-1] + 1, -(-starts[-1] * q // p)))
        #: Bands of size, each the least similarity's share of the next: linked sets are of one band or of two side by side.
        self.starts = np.array(starts, np.int64)
        # Segments hold `mean` elements on average, as many as leave enough of at least `shortest` for the pigeonhole.
        wanted = 1.06 * (q - p) / p
        means = np.arange(0.4, 12, 0.05)
        for self.shortest, share in ((2, 1 - np.exp(-means) * (1 + means)), (1, 1 - np.exp(-means))):
            enough = means[share / means >= wanted]
            if len(enough):
                break
        self.mean = float(enough[-1]) if len(enough) else 0.5

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def segments(self, of: int) -> int:
        """Into how many segments sets are cut to meet, when the smaller of two is in this octave."""
        return int(((2 << of) - 1) / self.mean) + 1

    def most_apart(self, n: int, of: int) -> int:
        """How many elements a set of n and a linked one differ in at most, when the smaller of them is in this octave."""
        partner = n * self.q // self.p if of == octave(n) else (2 << of) - 1
        return (n + partner) * (self.q - self.p) // (self.q + self.p)

    def keyed(self, n: int) -> range:
        """The octaves of the smaller set for which a set of this size makes keys: its own and those of smaller partners."""
        return range(octave(-(-n * self.p // self.q)), octave(n) + 1)

    def in_group(self, band: int) -> int:
        """Classes of this band whose bitmaps go to one tile."""
        return max(1, min(GROUP, GROUP_BYTES // (bits_of(int(self.starts[band + 1])) // 8)))

    def in_tile(self, band: int) -> int:
        """Classes of this band whose texts go to one tile."""
        return max(1, min(VERIFIED, TILE // int(self.starts[band])))


def keys(s: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The keys by which the set meets every set that it may link with, as unsigned 64-bit hashes."""
    n, out = len(s), []
    prefix = n * scheme.p <= (SMALL - 1) * scheme.q  # it may link with a small set
    if n >= SMALL:
        mixed = mix64(s ^ _P)
        for of in scheme.keyed(n):
            segment = ((mixed >> np.uint64(32)) * np.uint64(scheme.segments(of))) >> np.uint64(32)
            order = np.argsort(segment, kind="stable")
            cut = segment[order]
            starts = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]]))
            long = np.flatnonzero(np.diff(starts, append=n) >= scheme.shortest)
            made = mix64(np.add.reduceat(mixed[order], starts) ^ mix64(cut[starts] + np.uint64((of + 1) << 40)))
            need = scheme.most_apart(n, of) + 1
            prefix |= len(made) < need
            out.append(made[long[:need]] if len(long) >= need else made)
    if prefix and n:
        head = s[: n - -(-n * scheme.p // scheme.q) + 1]
        out.append(mix64(head + np.uint64(0x5851F42D4C957F2D)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bits_of(n: int) -> int:
    """Bits of the bitmap of a set of n: two to four an element, the same in an octave."""
    return max(128, 4 << octave(max(n, 1)))


def bitmap(s: np.ndarray) -> bytes:
    """The set's elements hashed to bits; an odd number of elements on a bit sets it."""
    bits = bits_of(len(s))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_link(size_a: np.ndarray, maps_a: list[bytes], size_b: np.ndarray, maps_b: list[bytes], least: tuple[int, int]) -> np.ndarray:
    """Whether the bitmaps allow that the sets of a row link, for each row."""
    p, q = least
    both = size_a + size_b
    out = np.minimum(size_a, size_b) * q >= np.maximum(size_a, size_b) * p
    wide = np.array([(len(x), len(y)) for x, y in zip(maps_a, maps_b, strict=True)]).reshape(-1, 2)
    for a, b in np.unique(wide[out], axis=0).tolist():
        rows = np.flatnonzero(out & (wide == (a, b)).all(1))
        x = np.frombuffer(b"".join([maps_a[r] for r in rows]), np.uint64).reshape(len(rows), -1)
        y = np.frombuffer(b"".join([maps_b[r] for r in rows]), np.uint64).reshape(len(rows), -1)
        x, y = (folded(x) if a > b else x), (folded(y) if b > a else y)
        bound = (both[rows] - np.bitwise_count(x ^ y).sum(1, dtype=np.int64)) // 2
        out[rows] = q * bound >= p * (both[rows] - bound)
    return out


def folded(maps: np.ndarray) -> np.ndarray:
    """The bitmaps with half the bits: the exclusive or of both halves."""
    half = maps.shape[1] // 2
    return maps[:, :half] ^ maps[:, half:]


def link_tile(sizes: np.ndarray, maps: list[bytes], least: tuple[int, int], side: np.ndarray | None = None, sets: list[np.ndarray] | None = None) -> np.ndarray:
    """A root for each set, joined along all links, or without `sets` along all pairs that the bitmaps let pass: among
    all sets, or with `side` between those of the two sides."""
    p, q = least
    order = np.argsort(sizes, kind="stable")
    size = sizes[order]
    side = None if side is None else side[order]
    octaves = np.array([octave(int(n)) for n in size])
    matrix, first = {}, {}
    for of in np.unique(octaves).tolist():
        rows = np.flatnonzero(octaves == of)
        first[of] = int(rows[0])
        own = np.frombuffer(b"".join(maps[order[r]] for r in rows), np.uint64).reshape(len(rows), -1)
        matrix[of] = own, folded(own) if bits_of(1 << of) > bits_of(1 << of >> 1) else own
    last = np.searchsorted(size, size * q // p, "right")
    root = np.arange(len(size))
    for i in range(len(size)):
        of = int(octaves[i])
        mine = matrix[of][0][i - first[of]]
        for other in (of, of + 1):
            if other not in matrix:
                continue
            lo, hi = max(i + 1, first[other]), min(int(last[i]), first[other] + len(matrix[other][0]))
            if lo >= hi:
                continue
            wanted = root[lo:hi] != root[i]
            if side is not None:
                wanted &= side[lo:hi] != side[i]
            others = lo + np.flatnonzero(wanted)
            if not len(others):
                continue
            apart = np.bitwise_count(matrix[other][other != of][others - first[other]] ^ mine).sum(1, dtype=np.int64)  # at most the symmetric difference
            both = size[others] + size[i]
            bound = (both - apart) // 2  # of the overlap, from above
            passed = others[q * bound >= p * (both - bound)]
            if sets is not None:
                for j in passed.tolist():
                    if root[j] == root[i]:
                        continue
                    common = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
                    if q * common >= p * (size[i] + size[j] - common):
                        a, b = root[i], root[j]
                        root[root == max(a, b)] = min(a, b)
            elif len(passed):
                joined = np.unique(np.append(root[passed], root[i]))
                root[np.isin(root, joined)] = joined[0]
    out = np.empty(len(size), np.int64)
    out[order] = order[root]
    return out


def _sets(docs: DataFrame, key: str, text: str, words: int, scheme: Scheme) -> DataFrame:
    """key, row_key, _text_key, n_shingles, cls (the set's hash, null for empty sets), band, bits, keys. A task gives bitmap
    and keys of a class once, which keeps large groups of copies out of the shuffle."""

    def run(batches):
        seen = set()
        for batch in slices(batches, text):
            sizes, cls, band, bits, made = [], [], [], [], []
            for t in batch.column(text).to_pylist():
                s = shingles(t, words)
                c = set_hash(s) if len(s) else None
                new = c is not None and c not in seen
                sizes.append(len(s))
                cls.append(c)
                band.append(scheme.band(len(s)) if len(s) else None)
                bits.append(bitmap(s) if new else None)
                made.append(keys(s, scheme).view(np.int64) if new else None)
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(c)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
            columns = [pa.array(x, kind) for x, kind in zip((sizes, cls, band, bits, made), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:3]] + columns, names=names)
        _words.clear()  # cheap to fill again; idle workers should hold little while Spark sorts the keys

    names = [key, "row_key", "_text_key", "n_shingles", "cls", "band", "bits", "keys"]
    schema = f"{key} long, row_key long, _text_key long, n_shingles long, cls long, band int, bits binary, keys array<long>"
    return docs.select(*names[:3], text).mapInArrow(frugal(run), schema)


def _frequent(made: DataFrame, parts: int) -> DataFrame:
    """k of the keys that hold a good part of a partition's share of all rows, by the classes that are looked at: at most
    HOT * parts of them, whatever the number of rows."""
    seen = made.filter(F.pmod(F.xxhash64("cls", F.lit("seen")), F.lit(SEEN)) == 0).groupBy("k").agg(F.count("*").alias("n"))
    seen = stored(seen, "seen")
    least = max(32, (seen.agg(F.sum("n")).first()[0] or 0) // (HOT * parts))
    return seen.filter(F.col("n") >= least).select("k")


def _groups(sets: DataFrame) -> DataFrame:
    """grp, many, cls: the classes that share a key, equal groups once. Keys are dealt by one shuffle, and one sort serves
    both windows; a class and key that come doubled from copies meet there. Frequent keys, a bounded number, do not go that
    way: their classes are dealt by class and key, and what a window would tell of them is aggregated before it is shuffled."""
    made = sets.select("cls", F.explode("keys").alias("k"))
    often = _frequent(made, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    group = Window.partitionBy("k")
    marks = {"total": F.sum(F.pmod(F.xxhash64("cls"), F.lit(1 << 40))), "many": F.count("*"), "low": F.min("cls"), "high": F.max("cls")}
    before = F.lag("cls").over(group.orderBy("cls"))
    rare = made.join(F.broadcast(often), "k", "left_anti").withColumn("before", before).filter("before IS NULL OR before <> cls")
    rare = rare.select("cls", *(m.over(group).alias(n) for n, m in marks.items()))
    hot = made.join(F.broadcast(often), "k", "left_semi").distinct()
    told = hot.groupBy("k").agg(*(m.alias(n) for n, m in marks.items()))  # a row for each frequent key
    both = rare.unionByName(hot.join(F.broadcast(told), "k").drop("k"))
    return both.filter("many > 1").select("cls", "many", F.xxhash64("total", "many", "low", "high").alias("grp")).distinct()


def _chunks(bands: dict[int, int], most: Callable[[int], int], cls: int, own: int) -> Iterator[tuple[str, int]]:
    """The tiles that a class goes to, each with its side: all pairs of chunks of its band and of the bands beside it."""
    chunk = cls % -(-bands[own] // most(own))
    for other in range(max(0, own - 1), own + 2):
        for c in range(-(-bands.get(other, 0) // most(other))):
            a, b = sorted([(own, chunk), (other, c)])
            yield f"{a[0]} {a[1]} {b[0]} {b[1]}", 0 if a == b else 1 if (own, chunk) == a else 2


def _starts(table: pa.Table) -> np.ndarray:
    """Where the tiles begin in rows sorted by tile."""
    new = np.ones(len(table), bool)
    new[1:] = False
    for c in ("grp", "tile"):
        x = table.column(c).to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _plausible(groups: DataFrame, classes: DataFrame, scheme: Scheme) -> DataFrame:
    """cls, root for classes that the bitmaps may link. groups: grp, many, cls; classes: cls, n, band, bits."""
    heavy = classes.filter(F.length("bits") > GROUP_BYTES // GROUP).select("cls")
    heavy = stored(groups.join(heavy, "cls", "left_semi").select("grp").distinct().withColumn("heavy", F.lit(True)), "heavy")  # so that groups can be split
    rows = groups.join(heavy, "grp", "left").join(classes, "cls")
    in_tiles = (F.col("many") > GROUP) | F.coalesce("heavy", F.lit(False))
    large = rows.filter(in_tiles)
    per_band = large.groupBy("grp", "many", "band").agg(F.count("*").alias("of"))
    in_band = per_band.groupBy("grp", "many").agg(F.map_from_entries(F.collect_list(F.struct("band", "of"))).alias("in_band"))
    large = large.join(in_band, ["grp", "many"])

    def place(batches):
        for batch in batches:
            out = []
            for row, (cls, own, counts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cls", "band", "in_band")), strict=True)):
                out += [(row, tile, side) for tile, side in _chunks(dict(counts), scheme.in_group, cls, own)]
            for lo in range(0, len(out), 10_000):
                row, tile, side = zip(*out[lo : lo + 10_000], strict=True)
                kept = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*(kept.column(c) for c in ("grp", "many")), pa.array(tile), pa.array(side, pa.int32()), *(kept.column(c) for c in ("cls", "n", "bits"))],
                    names=["grp", "many", "tile", "side", "cls", "n", "bits"],
                )

    def joined(table: pa.Table) -> pa.Table:
        """Edges within whole tiles. Every row is first compared with its tile's first row, for all tiles at once."""
        cls, sizes, bits = table.column("cls").to_numpy(), table.column("n").to_numpy(), table.column("bits").to_pylist()
        side, starts = table.column("side").to_numpy(), _starts(table)
        ends = np.append(starts[1:], len(cls))
        first = np.repeat(starts, ends - starts)
        links = first != np.arange(len(cls))
        rest = np.flatnonzero(links)
        links[rest] = may_link(sizes[rest], [bits[r] for r in rest], sizes[first[rest]], [bits[r] for r in first[rest]], (scheme.p, scheme.q))
        links[side > 0] = False
        a, b = [cls[links]], [cls[first[links]]]
        more = (ends - starts > 2) & (np.add.reduceat(links, starts) < ends - starts - 1) | (side[starts] > 0)
        for lo, hi in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
            root = link_tile(sizes[lo:hi], bits[lo:hi], (scheme.p, scheme.q), side[lo:hi] if side[lo] else None)
            has = np.flatnonzero(root != np.arange(len(root)))
            a.append(cls[lo + has])
            b.append(cls[lo + root[has]])
        return pa.table({"cls": np.concatenate(a), "root": np.concatenate(b)})

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            cut = int(_starts(table)[-1])  # the last tile may go on in the next batch
            held = table.slice(cut)
            if cut:
                yield from joined(table.slice(0, cut)).to_batches()
        if held is not None:
            yield from joined(held).to_batches()

    tile = "grp long, many long, tile string, side int, cls long, n long, bits binary"
    whole = rows.filter(~in_tiles).select("grp", "many", F.lit("").alias("tile"), F.lit(0).alias("side"), "cls", "n", "bits")
    placed = whole.unionByName(large.select("grp", "many", "cls", "n", "band", "bits", "in_band").mapInArrow(frugal(place), tile))
    return placed.repartition("grp", "tile").sortWithinPartitions("grp", "many", "tile").mapInArrow(frugal(run), "cls long, root long").distinct()


def _verified(members: DataFrame, scheme: Scheme, words: int, text: str) -> DataFrame:
    """cls, root along the links in all tiles of all clusters. members: cluster, cls, band, many (of the cluster), in_band,
    text."""

    def place(batches):
        seen = set()
        for batch in slices(batches, text):
            cols = [batch.column(c).to_pylist() for c in ("cluster", "cls", "band", "many", "in_band")]
            out = []
            for row, (cluster, cls, own, many, in_band) in enumerate(zip(*cols, strict=True)):
                if cls in seen:
                    continue  # a repeated row
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(cls)
                counts = dict(in_band)
                if many <= scheme.in_tile(max(counts)):
                    out.append((f"{cluster}", row, 0))
                else:
                    out += [(f"{cluster} {tile}", row, side) for tile, side in _chunks(counts, scheme.in_tile, cls, own)]
            if not out:
                continue
            tile, row, side = zip(*out, strict=True)
            row = np.array(row)
            for lo, hi in spans(text_bytes(batch, text)[row], PLACED):  # a text goes to many tiles, so its copies are cut too
                kept = batch.take(pa.array(row[lo:hi]))
                yield pa.RecordBatch.from_arrays([pa.array(tile[lo:hi]), pa.array(side[lo:hi], pa.int32()), kept.column("cls"), kept.column(text)], names=["tile", "side", "cls", text])

    def run(table: pa.Table) -> pa.Table:
        cls, side = table.column("cls").to_numpy(), table.column("side").to_numpy()
        sets = [shingles(t, words) for t in table.column(text).to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        root = link_tile(sizes, [bitmap(s) for s in sets], (scheme.p, scheme.q), side if side.any() else None, sets)
        has = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"cls": cls[has], "root": cls[root[has]]})

    placed = members.mapInArrow(frugal(place), f"tile string, side int, cls long, {text} string")
    return placed.groupBy("tile").applyInArrow(run, "cls long, root long")


def _classes(docs: DataFrame, key: str, text: str, words: int, least: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(key, row_key, _text_key, n_shingles, cls) for each row of docs, which has only key, text, row_key and _text_key; the
    last two name a row's text where ids are repeated. (cls, row_key, _text_key, least_id, component) for each class."""
    scheme = Scheme(least)
    sets = stored(_sets(docs, key, text, words, scheme), "shingle-sets")
    groups = stored(_groups(sets), "groups")
    plain = stored(sets.drop("keys"), "shingle-counts")
    drop(sets)
    classes = plain.filter("bits IS NOT NULL").select("cls", F.col("n_shingles").alias("n"), "band", "bits").dropDuplicates(["cls"])
    edges = stored(_plausible(groups, classes, scheme), "plausible")
    drop(groups)
    found = components(edges, "cls", "root").select(F.col("node").alias("cls"), F.col("component").alias("cluster"))
    drop(edges)
    clusters = stored(found, "clusters")
    first = F.min(F.struct(F.col(key).isNull(), F.col(key).alias("least_id"), "row_key", "_text_key")).alias("x")
    plain = plain.drop("bits")
    names = plain.filter("cls IS NOT NULL").groupBy("cls").agg(first, F.max("band").alias("band")).select("cls", "x.least_id", "x.row_key", "x._text_key", "band")
    sized = clusters.join(names, "cls")
    in_band = sized.groupBy("cluster", "band").agg(F.count("*").alias("n"))
    many = in_band.groupBy("cluster").agg(F.sum("n").alias("many"), F.map_from_entries(F.collect_list(F.struct("band", "n"))).alias("in_band"))
    wanted = sized.join(many, "cluster").select("row_key", "_text_key", "cls", "cluster", "band", "many", "in_band")
    members = docs.select("row_key", "_text_key", text).join(wanted, ["row_key", "_text_key"]).select("cluster", "cls", "band", "many", "in_band", text)
    links = stored(_verified(members, scheme, words, text), "links")
    drop(clusters)
    found = components(links, "cls", "root").select(F.col("node").alias("cls"), "component")
    named = stored(names.join(found, "cls", "left").select("cls", "row_key", "_text_key", "least_id", F.coalesce("component", "cls").alias("component")), "classes")
    drop(links)
    return plain, named


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, and row_key (the id, or a hash of the text where it is null) and _text_key."""
    return docs.select(F.col(key).cast("long").alias(key), text).withColumns({"row_key": F.coalesce(key, F.xxhash64(text)), "_text_key": F.xxhash64(text)})


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """key, n_shingles, component_id: a row for each document."""
    plain, named = _classes(_named(docs, key, text), key, text, words, least)
    least_id = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_class = named.join(least_id, "component").select("cls", "component_id")
    result = plain.join(by_class, "cls", "left")
    return result.select(key, "n_shingles", F.when(F.col("cls").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of docs without all but one document of each component: that of the smallest id stays. Documents without
    shingles stay. Rows of equal id and text count as one document."""
    plain, named = _classes(_named(docs, key, text), key, text, words, least)
    first = F.min(F.struct(F.col("least_id").isNull(), "least_id", "row_key", "_text_key"))
    chosen = named.groupBy("component").agg(first.alias("x")).select("x.row_key", "x._text_key")
    stay = chosen.unionByName(plain.filter("cls IS NULL").select("row_key", "_text_key")).distinct()
    row_key, text_key = free_name(docs, "row_key"), free_name(docs, "_text_key")
    keyed = docs.withColumns({row_key: F.coalesce(F.col(key).cast("long"), F.xxhash64(text)), text_key: F.xxhash64(text)})
    kept = keyed.join(stay.toDF(row_key, text_key), [row_key, text_key], "left_semi")
    return kept.dropDuplicates([row_key, text_key]).select(*docs.columns)
