"""Packing documents into sequences of a fixed number of tokens by the sum of squares.

Documents become token ids with an end id; longer ones are cut into full pieces and a rest. Full pieces are sequences of
their own. The rests are dealt to shards of about SHARD pieces, and every shard packs its own, longest first: a piece
goes where the sum over residual gaps of the squared number of open bins with that gap becomes smallest; of equal
choices, into the smallest gap. A new bin opens where none has room. Only numbers are shuffled for that, never ids.

Defined results: a null text is the empty text, which is the end id alone; repeated rows are packed each on their own;
an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arpent.llm.common import frugal, stored
from arpent.llm.bpe import slices

#: Tokens of a sequence, the id that ends a document, and pieces that one task packs together.
CAPACITY, END_ID, SHARD = 4096, 1, 25_000
#: Bytes of text that are encoded together.
AT_ONCE = 6_000_000
#: Signs that make token runs of their own after a letter or digit: ASCII punctuation.
MARKS = string.punctuation


def _gathered(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ids that begin at start, one after another."""
    places = np.repeat(start - (np.cumsum(size) - size), size)
    places += np.arange(len(places))
    return ids[places]


class ChunkEncoder:
    """Token ids of whole texts. The tokenizer never joins what a blank or a line feed separates, so the different chunks
    between those are encoded once a batch. Marks behind a letter or digit are token runs of their own and are encoded
    apart from what they follow. All but the tokenizer's own work is done on whole arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.closed: dict[str, bool] = {}
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.is_end[ends] = True

    def _closed(self, sign: str) -> bool:
        """Whether marks behind this sign are a token run of their own: it stays a letter or digit when normalized."""
        found = self.closed.get(sign)
        if found is None:
            found = self.closed[sign] = unicodedata.normalize("NFC", sign) == sign and sign.isalnum() and sign.lower().isalnum()
        return found

    def _parted(self, chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each chunk without the marks at its end, and these marks; all of it and nothing where they hang together."""
        heads = pc.ascii_rtrim(chunks, characters=MARKS)
        marked = pc.and_(pc.less(pc.binary_length(heads), pc.binary_length(chunks)), pc.greater(pc.binary_length(heads), 0))
        for token in self.special:
            marked = pc.and_not(marked, pc.match_substring(chunks, token))
        signs = pc.dictionary_encode(pc.utf8_slice_codeunits(heads, -1, None))
        closed = np.array([self._closed(x) for x in signs.dictionary.to_pylist()], bool)
        marked = pc.and_(marked, pa.array(closed[signs.indices.to_numpy()]))
        tails = pc.replace_substring_regex(chunks, f"(?s)^.*[^{re.escape(MARKS)}]", "")
        return pc.if_else(marked, heads, chunks), pc.if_else(marked, tails, "")

    def _encoded(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each chunk's begin and how many they are. Chunks of letters alone are one token sequence up to
        an end-of-word token, so many are encoded as one text."""
        batch = self.tokenizer.encode_batch_fast
        start, size, all_ids, n = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), [np.zeros(0, np.uint32)], 0
        alpha = pc.utf8_is_alpha(chunks).to_numpy(zero_copy_only=False)
        letters, rest = np.flatnonzero(alpha), [np.flatnonzero(~alpha)]
        for lo in range(0, len(letters), 8192):
            part = letters[lo : lo + 8192]
            ids = np.array(batch([" ".join(chunks.take(pa.array(part)).to_pylist())], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(part):  # some letter does not stay one
                rest.append(part)
                continue
            size[part] = np.diff(ends, prepend=0)
            start[part] = n + ends - size[part]
            all_ids.append(ids)
            n += len(ids)
        for k, found in zip(np.concatenate(rest).tolist(), batch(chunks.take(pa.array(np.concatenate(rest))).to_pylist(), add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            start[k], size[k] = n, len(ids)
            all_ids.append(ids)
            n += len(ids)
        return np.concatenate(all_ids), start, size

    def lay_out(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin and end; no end ids."""
        texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        chunks = split.flatten().dictionary_encode()
        heads, tails = (x.dictionary_encode() for x in self._parted(chunks.dictionary))
        ids, start, size = self._encoded(heads.dictionary)
        more, more_start, more_size = self._encoded(tails.dictionary)
        ids, start, size = np.concatenate([ids, more]), np.concatenate([start, len(ids) + more_start]), np.concatenate([size, more_size])
        both = np.stack([heads.indices.to_numpy(), len(heads.dictionary) + tails.indices.to_numpy()], 1).ravel()
        ids, size = _gathered(ids, start[both], size[both]), size[both].reshape(-1, 2).sum(1)
        start, at = np.cumsum(size) - size, chunks.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[at])])
        bounds = split.offsets.to_numpy()
        return _gathered(ids, start[at], size[at]), ends[bounds - bounds[0]]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """For each text its ids, four bytes each, without an end id."""
        ids, ends = self.lay_out(pa.array(texts, pa.large_string()))
        return [ids[lo:hi].tobytes() for lo, hi in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def tokenized(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """A row for each document: key and ids, the end id included."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        for batch in slices(batches, text, AT_ONCE):
            ids = [x + end for x in encoder(path).encode(batch.column(text))]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(ids, pa.binary())], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(frugal(run), f"{key} {docs.schema[key].dataType.simpleString()}, ids binary")


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32 and, if asked for, its ids. One pass, so that a task
    needs one Python worker."""

    def run(batches):
        for batch in slices(batches, text, AT_ONCE):
            ids, ends = encoder(path).lay_out(batch.column(text))
            sizes = np.diff(ends) + 1  # with the end id
            ids = np.insert(ids, ends[1:], np.uint32(end_id)).astype("<u4", copy=False)
            count = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            first = (np.cumsum(sizes) - sizes)[row] + start
            raw = memoryview(ids).cast("B")
            parts = [raw[4 * lo : 4 * hi] for lo, hi in zip(first.tolist(), (first + length).tolist(), strict=True)]
            cols = [batch.column(key).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
            if with_ids:
                cols.append(pa.array([bytes(x) for x in parts], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=names[: len(cols)])

    names = [key, "piece", "start", "length", "ids_crc32", "ids"]
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return docs.select(key, text).mapInArrow(frugal(run), schema + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each length, in the given order."""
    open_bins = np.zeros(capacity + 1, np.int64)  # how many open bins have this gap
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        fits, gap = size + np.flatnonzero(open_bins[size:capacity]), capacity
        if len(fits):
            after = np.where(fits > size, 2 * open_bins[fits - size] + 1, 0)
            gap = int(fits[(after - 2 * open_bins[fits]).argmin()])
        if gap == capacity:
            bin_, made = made, made + 1
        else:
            bin_ = gaps[gap].pop()
            open_bins[gap] -= 1
        where[i], offset[i] = bin_, capacity - gap
        if gap > size:
            gaps[gap - size].append(bin_)
            open_bins[gap - size] += 1
    return where, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """The pieces with sequence_id and offset. `pieces` must be stored: it is counted and then read again."""
    kept = pieces.columns
    numbered = pieces.withColumn("_row", F.monotonically_increasing_id())
    rest = numbered.filter(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard))
    whole = numbered.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("_row")).withColumn("offset", F.lit(0).cast("long"))

    def run(group: pa.Table) -> pa.Table:
        lengths, rows = group.column("length").to_numpy(), group.column("_row").to_numpy()
        order = np.lexsort((rows, -lengths))
        where, offset = sum_of_squares(lengths[order], capacity)
        group = group.take(pa.array(order))
        number = group.column("_shard").to_numpy().astype(np.int64) << 32 | where
        return pa.table({**{c: group.column(c) for c in [*kept, "_row"]}, "sequence_id": number, "offset": offset})

    rest = rest.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    packed = rest.groupBy("_shard").applyInArrow(run, whole.schema)
    return whole.unionByName(packed).select(*kept, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize, cut and pack documents; one row for each piece."""
    return pack(stored(pieces(docs, path, key, text), "pieces"))


def sequences(packed: DataFrame, with_ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids. `with_ids` holds the ids of every piece."""
    joined = packed.select(key, "piece", "sequence_id", "offset").join(with_ids.select(key, "piece", "ids"), [key, "piece"])
    parts = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
