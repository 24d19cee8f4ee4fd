"""Byte-level BPE encoding and decoding on padded numpy matrices.

Pieces of text go into matrices by length. In each round every row merges its leftmost pair of minimum rank; pairs are
looked up in a hash table of numpy arrays and the rows are compacted. Pieces longer than LONGEST bytes would make that
quadratic; they are merged by a priority queue instead, with the same result.

Defined results: a null text is the empty text and has no ids; repeated texts have equal ids; the text of every length
is encoded whole. Ids without bytes in the vocabulary raise KeyError on decoding.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from arpent.llm.common import Memo

#: Pieces above this many bytes leave the matrices for the priority queue: a round looks at a whole row, so work is
#: quadratic in the width. A piece of 400 random letters takes 0.3 ms in a matrix and 0.4 ms in the queue, one of 1000 1.6 and
#: 1.0, one of 4000 20 and 4.
LONGEST = 1024
#: Upper widths of the matrices.
WIDTHS = (4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 512, LONGEST)
#: Cells of a matrix.
CELLS = 2_097_152
NO_RANK = np.int32(2**31 - 1)
#: Chunks of text that a worker remembers.
REMEMBERED = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line holds a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """Open addressing from a pair of ids to the id of their merge, all in numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = rank
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, int(len(pairs)).bit_length() + 2)
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NO_RANK, np.int32)
        at, self.probes = self._slot(keys), 0
        left = np.arange(len(keys))
        while len(left):  # each round seats one key a free slot; the rest try the next slot
            self.probes += 1
            free = self.keys[at[left]] == -1
            self.keys[at[left[free]]] = keys[left[free]]
            seated = self.keys[at[left]] == keys[left]
            self.values[at[left[seated]]] = values[left[seated]]
            left = left[~seated]
            at[left] = (at[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, NO_RANK where none; ids below 0 are padding."""
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        found = np.full(len(keys), NO_RANK, np.int32)
        held = self.keys[at]
        hit = held == keys
        found[hit] = self.values[at[hit]]
        rest = np.flatnonzero(~hit & (held != -1))
        for _ in range(self.probes):
            if not len(rest):
                break
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            held = self.keys[at[rest]]
            hit = held == keys[rest]
            found[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (held != -1)]
        return found


class Codec:
    """Encoder and decoder for one vocabulary and one pattern."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.bytes_of = {rank: token for token, rank in self.tokens.items()}
        self.pairs = PairTable(self.tokens)
        self.single = np.array([self.tokens[bytes([b])] for b in range(256)], np.int32)
        self.find = regex.compile(pattern).findall
        self.memo = Memo(REMEMBERED)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """For each piece its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.tokens.get(piece)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > LONGEST:
                out[i] = self._merge_long(piece)
            elif piece:
                by_width.setdefault(next(w for w in WIDTHS if len(piece) <= w), []).append(i)
        for width, rows in by_width.items():
            step = max(1, min(16384, CELLS // width))
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                self._merge_matrix([pieces[i] for i in part], width, part, out)
        return out

    def _merge_matrix(self, pieces: list[bytes], width: int, places: list[int], out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        sizes = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < sizes[:, None], self.single[raw], np.int32(-1))
        ranks = self.pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        place = np.array(places)
        while len(ids):
            at = ranks.argmin(1)  # the first of equal ranks: the leftmost
            row = np.arange(len(ids))
            best = ranks[row, at]
            done = best == NO_RANK
            if done.any():
                for k in np.flatnonzero(done):
                    line = ids[k]
                    out[place[k]] = line[line >= 0].astype("<u4").tobytes()
                go = ~done
                ids, ranks, place, at, best = ids[go], ranks[go], place[go], at[go], best[go]
                row = np.arange(len(ids))
                if not len(ids):
                    break
            ids[row, at] = best
            keep = np.ones(ids.shape, bool)
            keep[row, at + 1] = False
            width = ids.shape[1] - 1
            ids = ids[keep].reshape(len(row), width)
            if width < 2:
                for k in row:
                    out[place[k]] = ids[k][ids[k] >= 0].astype("<u4").tobytes()
                break
            keep = np.ones(ranks.shape, bool)
            keep[row, np.minimum(at, ranks.shape[1] - 1)] = False
            ranks = ranks[keep].reshape(len(row), width - 1)
            for beside in (at - 1, at):  # only the pairs beside the merge changed
                there = np.flatnonzero((beside >= 0) & (beside < width - 1))
                c = beside[there]
                ranks[there, c] = self.pairs.ranks(ids[there, c], ids[there, c + 1])

    def _merge_long(self, piece: bytes) -> bytes:
        ids = [int(self.single[b]) for b in piece]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(ids):
                token = self.bytes_of[ids[i]] + self.bytes_of[ids[after[i]]]
                if (rank := self.tokens.get(token)) is not None:
                    heapq.heappush(queue, (rank, i, ids[i], ids[after[i]]))

        for i in range(len(ids) - 1):
            offer(i)
        while queue:
            rank, i, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue  # one of the two has merged since
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    #: Two blanks in one run of white space: there the pieces of a chunk depend on its neighbours.
    tangled = re.compile(r" \s* ")

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """For each text its ids, four bytes each. Chunks between single blanks are encoded once and remembered."""
        split = []
        for text in texts:
            text = text or ""
            if text[:1].isspace() or text[-1:].isspace() or self.tangled.search(text):
                pieces = self.find(text)
                split.append(("p", pieces))
            elif text:
                first, *rest = text.split(" ")
                split.append(("c", self.find(first), rest))
            else:
                split.append(("p", []))
        memo = self.memo
        memo.room(sum(len(x[-1]) for x in split))
        singles = {p for x in split for p in x[1]}
        chunks = set().union(*(x[2] for x in split if x[0] == "c"))
        wanted = {("p", p): [p] for p in singles if ("p", p) not in memo}
        wanted.update({c: self.find(" " + c) for c in chunks if c not in memo})
        pieces = list({p for found in wanted.values() for p in found})
        known = dict(zip(pieces, self.merge([p.encode("utf-8", "surrogatepass") for p in pieces]), strict=True))
        for key, found in wanted.items():
            ids = memo[key] = known[found[0]] if len(found) == 1 else b"".join([known[p] for p in found])
            if len(ids) > 32:  # small ones are bounded by their number
                memo.held += 2 * len(ids)
        out = []
        for x in split:
            ids = b"".join([memo["p", p] for p in x[1]])
            out.append(ids + b"".join(map(memo.__getitem__, x[2])) if x[0] == "c" else ids)
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if len(numbers) < 2:
            return b"".join([self.bytes_of[i] for i in numbers])
        return b"".join(itemgetter(*numbers)(self.bytes_of))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def spans(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes each, or one row."""
    part = np.cumsum(sizes) // most if len(sizes) else sizes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return [(lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi > lo]


def text_bytes(batch: pa.RecordBatch, text: str) -> np.ndarray:
    return pc.fill_null(pc.cast(pc.binary_length(batch.column(text)), pa.int64()), 0).to_numpy(zero_copy_only=False)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `most` bytes of text, or one row."""
    for batch in batches:
        for lo, hi in spans(text_bytes(batch, text), most):
            yield batch.slice(lo, hi - lo)


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: its key and `ids`, the token ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        own = codec(path, pattern)
        for batch in slices(batches, text):
            ids = own.encode(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(ids, pa.binary())], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """A row for each encoded document: its key and `decoded`, the bytes of the text."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                back = [own.decode(x or b"") for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(back, pa.binary())], names=[key, "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"{key} {kind}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each document in one pass; of both only sizes and SHA-256 digests are returned."""

    def run(batches):
        own = codec(path, pattern)
        for batch in slices(batches, text):
            ids = own.encode(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids]),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
