"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors are brought to length one, turned by a fixed random rotation and cut into BLOCKS blocks of coordinates. Two
vectors of cosine at least t are at most 2 - 2t apart by squared distance, so in at least one block they are within that
block's share, which is proportional to its width. Each block is range-joined: slabs of its first coordinate, cut at
quantiles, meet all slabs within the block's radius; a pair of slabs is one task's tile. A tile sorts its vectors by that
coordinate too and compares only what is within the radius. Pairs within the block's budget are candidates, and their cosine is verified exactly in double precision. A pair belongs to the first
block whose budget it keeps, so the union over blocks counts it once. Tiles return counts for vectors and an edge from
each linked vector to a root, never pairs.

Equal vectors are one class from the start. Work grows with the square of the number of different vectors where the
slabs of a wide radius do not part them, as in any exact join of this kind; slabs beyond MOST_SLABS are dealt by hash.

Defined results: null, empty and zero vectors and those with null or non-finite components link with nothing; vectors
of different lengths do not link; null ids are vectors like others and are never a component's name unless all its ids
are null; repeated rows link with each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arpent.llm.common import stored
from arpent.llm.graph import components

#: Least cosine of a link, blocks of coordinates, bytes of a slab's vectors in double precision, most slabs, and rows and
#: columns compared at once.
LEAST, BLOCKS, SLAB_BYTES, MOST_SLABS, STRIPE, COLUMNS = 0.9, 4, 16_777_216, 4096, 64, 8192
#: Slack for rounding of squared distances of unit vectors: in single precision for candidates, in double for budgets.
SLACK32, SLACK64 = 1e-5, 1e-9
#: Bytes of the vectors of candidate pairs that are verified at once.
AT_ONCE = 20_480_000


def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.RandomState(20240811 + dim).standard_normal((dim, dim)))[0]


def blocks(dim: int) -> list[tuple[int, int]]:
    """The first and last coordinate of each block."""
    n = max(1, min(BLOCKS, dim // 4))
    cuts = [dim * k // n for k in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def slab_of(dim: int) -> int:
    """Vectors of a slab, and at most of a side of a tile."""
    return max(64, SLAB_BYTES // (8 * dim))


def _vectors(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """key, cls (a hash of the components, null for vectors that link with nothing), dim, raw (the components)."""
    kind = "<f4" if vectors.schema[embedding].dataType.elementType.simpleString() == "float" else "<f8"

    def run(batches):
        for batch in batches:
            cls, dims, raws = [], [], []
            for x in batch.column(embedding):
                v = None
                if x.is_valid and len(x) and not x.values.null_count:
                    v = x.values.to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)  # no negative zeros
                    v = v if np.isfinite(v).all() and v.any() else None
                raw = None if v is None else v.tobytes()
                raws.append(raw)
                dims.append(None if v is None else len(v))
                cls.append(None if v is None else int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(cls, pa.int64()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=[key, "cls", "dim", "raw"])

    return vectors.select(F.col(key).cast("long").alias(key), embedding).mapInArrow(run, f"{key} long, cls long, dim int, raw binary")


def _matrix(raws, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raws), kind).reshape(-1, dim).astype(np.float64)


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors divided by powers of two, which is exact and keeps squares from over- and underflow, and their lengths."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x, np.sqrt((x * x).sum(1))


def _unit(x: np.ndarray) -> np.ndarray:
    x, length = _scaled(x)
    return x / length[:, None]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(1)


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Merge the sets named by root along the pairs."""
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root[a] == root[b]).all():
            return root


def _stripes(x: np.ndarray, first: int, b0: int, b1: int, radius: float, one: bool):
    """(row, column, columns) of pieces of at most STRIPE rows and COLUMNS columns in which rows before `first` can meet
    columns from b0 to b1: both are sorted by x, and x may differ by the radius."""
    for r in range(0, first, STRIPE):
        low, high = x[r] - radius, x[min(r + STRIPE, first) - 1] + radius
        c = b0 + int(np.searchsorted(x[b0:b1], low, "left"))
        end = b0 + int(np.searchsorted(x[b0:b1], high, "right"))
        c = max(c, r) if one else c
        for at in range(c, end, COLUMNS):
            yield r, at, min(COLUMNS, end - at)


def _tile(table: pa.Table, dim: int, kind: str, least: float) -> pa.Table:
    """Links within one pair of slabs of one block: node, links, root for every node that has any."""
    block, one = int(table.column("block")[0].as_py()), bool(table.column("one")[0].as_py())
    side = table.column("side").to_numpy()
    spans = blocks(dim)
    lo, hi = spans[block]
    whole, length = _scaled(_matrix(table.column("raw").to_pylist(), kind, dim))
    turned = (whole / length[:, None]) @ rotation(dim)
    order = np.lexsort((table.column("cls").to_numpy(), turned[:, lo], side))
    whole, length, turned = whole[order], length[order], turned[order]
    cls, times, first = table.column("cls").to_numpy()[order], table.column("times").to_numpy()[order], int((side == 0).sum())
    total = 2 - 2 * least
    budgets = [total * (h - l) / dim + SLACK64 for l, h in spans]
    part = turned[:, lo:hi].astype(np.float32)
    square = (part * part).sum(1)
    links, root = np.zeros(len(cls), np.int64), np.arange(len(cls))
    ones = np.ones((len(cls), 1), np.float32)
    left, right = np.hstack([part, square[:, None], ones]), np.hstack([-2 * part, ones, square[:, None]]).T.copy()
    b0, b1 = (0, first) if one else (first, len(cls))
    x, radius, at_once = turned[:, lo], np.sqrt(budgets[block]) + SLACK32, max(256, AT_ONCE // (8 * dim))
    for r, c, width in _stripes(x, first, b0, b1, radius, one):
        rows = slice(r, min(r + STRIPE, first))
        gap = left[rows] @ right[:, c : c + width]  # squared distances in the block
        i, j = np.divmod(np.flatnonzero(gap <= np.float32(budgets[block] + SLACK32)), width)
        i, j = i + r, j + c
        if one:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), at_once):
            a, b = i[s : s + at_once], j[s : s + at_once]
            own = _squared(turned[a, lo:hi], turned[b, lo:hi]) <= budgets[block]
            for k in range(block):  # an earlier block keeps the pair
                l, h = spans[k]
                own &= ~(_squared(turned[a, l:h], turned[b, l:h]) <= budgets[k])
            a, b = a[own], b[own]
            near = (whole[a] * whole[b]).sum(1) / (length[a] * length[b]) >= least
            a, b = a[near], b[near]
            if len(a):
                np.add.at(links, a, times[b])
                np.add.at(links, b, times[a])
                root = _roots(len(cls), a, b, root)
    has = np.flatnonzero(links)
    return pa.table({"node": cls[has], "links": links[has], "root": cls[root[has]]})


def _joined(classes: DataFrame, dim: int, kind: str, least: float) -> DataFrame:
    """node, links, root from all tiles of the classes of one dimension."""
    classes = classes.filter(F.col("dim") == dim)
    spans, n = blocks(dim), classes.count()
    slab = slab_of(dim)
    slabs = max(1, min(MOST_SLABS, -(-n // slab)))
    chunks = max(1, -(-n // (slabs * slab)))
    turn = rotation(dim)

    def coordinates(batches):
        for batch in batches:
            turned = _unit(_matrix(batch.column("raw").to_pylist(), kind, dim)) @ turn
            yield pa.RecordBatch.from_arrays([pa.array(turned[:, lo]) for lo, _ in spans], names=[f"x{k}" for k in range(len(spans))])

    names = [f"x{k}" for k in range(len(spans))]
    bounds = [[] for _ in spans]
    if slabs > 1:
        first = classes.select("raw").mapInArrow(coordinates, ", ".join(f"{x} double" for x in names))
        bounds = first.approxQuantile(names, [k / slabs for k in range(1, slabs)], 0.1 / slabs)
    bounds = [np.array(sorted(set(b))) for b in bounds]
    radius = [float(np.sqrt((2 - 2 * least) * (h - l) / dim)) + 1e-6 for l, h in spans]

    def reach(k: int, i: int) -> range:
        """The slabs from i on that hold vectors within the radius of slab i."""
        last = len(bounds[k]) if i == len(bounds[k]) else int(np.searchsorted(bounds[k], bounds[k][i] + radius[k], "right"))
        return range(i, last + 1)

    reached = [[reach(k, i) for i in range(len(b) + 1)] for k, b in enumerate(bounds)]
    reached_by = [[[h for h in range(i + 1) if i in r[h]] for i in range(len(r))] for r in reached]

    def place(batches):
        for whole in batches:
            for lo in range(0, len(whole), 512):
                batch = whole.slice(lo, 512)
                turned = _unit(_matrix(batch.column("raw").to_pylist(), kind, dim)) @ turn
                chunk = (batch.column("cls").to_numpy().view(np.uint64) % np.uint64(chunks)).astype(int).tolist()
                out = []
                for k, (l, _) in enumerate(spans):
                    for row, s in enumerate(np.searchsorted(bounds[k], turned[:, l], "right").tolist()):
                        c = chunk[row]
                        for t in reached[k][s]:
                            for d in range(c if t == s else 0, chunks):
                                out.append((f"{k} {s} {c} {t} {d}", row, k, 0, (s, c) == (t, d)))
                        for h in reached_by[k][s]:
                            for d in range(c + 1 if h == s else chunks):
                                if (h, d) != (s, c):
                                    out.append((f"{k} {h} {d} {s} {c}", row, k, 1, False))
                tile, row, k, side, one = zip(*out, strict=True)
                kept = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tile), pa.array(k, pa.int32()), pa.array(side, pa.int32()), pa.array(one), kept.column("cls"), kept.column("times"), kept.column("raw")],
                    names=["tile", "block", "side", "one", "cls", "times", "raw"],
                )

    placed = classes.select("cls", "times", "raw").mapInArrow(place, "tile string, block int, side int, one boolean, cls long, times long, raw binary")
    return placed.groupBy("tile").applyInArrow(lambda t: _tile(t, dim, kind, least), "node long, links long, root long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", least: float = LEAST) -> DataFrame:
    """key, n_links, component_id, kept: a row for each vector."""
    kind = "<f4" if vectors.schema[embedding].dataType.elementType.simpleString() == "float" else "<f8"
    vectors = _vectors(vectors, key, embedding)
    grouped = vectors.filter("cls IS NOT NULL").groupBy("cls").agg(
        F.min(key).alias("least_id"), F.count("*").alias("times"), F.first("dim").alias("dim"), F.first("raw").alias("raw")
    )
    classes = stored(grouped, "classes")
    found = None
    for (dim,) in classes.select("dim").distinct().collect():
        one = _joined(classes, dim, kind, least)
        found = one if found is None else found.unionByName(one)
    names = classes.select("cls", "least_id", "times")
    if found is None:
        known = names.select("cls", F.col("least_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    else:
        found = stored(found, "links")
        links = found.groupBy(F.col("node").alias("cls")).agg(F.sum("links").alias("links"))
        member = components(found, "node", "root").withColumnRenamed("node", "cls")
        member = names.join(member, "cls", "left").select("cls", "least_id", "times", F.coalesce("component", "cls").alias("component"))
        member = stored(member, "members")
        named = member.groupBy("component").agg(F.min("least_id").alias("component_id"))
        known = member.join(named, "component").join(links, "cls", "left").select(
            "cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")
        )
    result = vectors.select(key, "cls").join(known, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col(key)).otherwise(F.col("component_id"))
    links = F.coalesce("n_links", F.lit(0)).cast("long")
    return result.select(key, links.alias("n_links"), component.alias("component_id"), F.col(key).eqNullSafe(component).alias("kept"))
