"""Token counts through a cache of digests.

A text's content, as the tokenizer normalizes it, has a digest; so has the tokenizer, with its file and the rule for
contents. The cache holds a count for each content under its tokenizer's version. A run joins the digests of all
documents, each once, to the cache; only texts of contents that are not there are encoded, one of each, and their counts
are appended to the cache as a batch of its own, which counts once it is complete. Then all documents get their counts by
digest.

Texts are read for their digests, and again for the misses: few misses, at most FEW, are sent to the texts, more of them
meet the texts in a shuffle by digest and key, so that copies do not gather. Everything else has a digest and a number a
row; digests are made one of each by partial aggregates. Runs at one time may append equal counts; reading takes one.

The library of the file's kind does the counting, without begin, end or added special tokens, truncation or padding;
special strings inside texts are what it takes them for. Long texts are cut for it only where its pieces end anyway.

Defined results: a null text is the empty text, of no bytes and, as the library says, mostly no tokens; texts of every
length are counted whole; repeated rows and null keys are rows of their own; an empty table gives an empty result and
appends nothing; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arpent.llm.bpe import slices
from arpent.llm.common import frugal, scratch, stored

#: The rule by which contents and counts are made; another one does not find what this one stored.
RULE = "content-1"
#: Misses that are broadcast, 40 bytes each.
FEW = 10_000
#: Characters that the library gets at once, and of which one piece of a text has at most, where it can be cut.
CHARS_AT_ONCE, PIECE = 250_000, 100_000
LIMIT = 1024
#: The session's setting by which the query is given a cache to keep.
CACHE_SETTING = "spark.arpent.token.cache"
CACHE = "digest binary, n_tokens bigint"


class Counter:
    """What one tokenizer file says of texts."""

    def __init__(self, path: str):
        self.is_pieces = path.endswith(".model")
        if self.is_pieces:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.normalizes, self.cuts = True, False
            return
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        added = made.get("added_tokens") or []
        self.special = [t["content"] for t in added]
        before = made.get("pre_tokenizer") or {}
        self.normalizes = made.get("normalizer") is not None
        plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and " " not in t["content"] for t in added)
        self.cuts = not self.normalizes and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and plain

    def content(self, text: str) -> bytes:
        """Equal for texts that have equal tokens because the tokenizer normalizes them to the same."""
        if not self.normalizes:
            return text.encode()
        if self.is_pieces:
            return self.model.normalize(text).encode()
        if any(s in text for s in self.special):
            return b"as it is\0" + text.encode()
        return b"normalized\0" + self.model.normalizer.normalize_str(text).encode()

    #: A blank between two letters or digits: a byte-level piece starts with it.
    gap = re.compile(r"(?<=[^\W_]) (?=[^\W_])")

    def pieces(self, text: str) -> list[str]:
        """The text cut into parts whose tokens together are its tokens."""
        if not self.cuts or len(text) <= PIECE:
            return [text]
        out, since = [], 0
        while len(text) - since > PIECE:
            cut = self.gap.search(text, since + PIECE)
            if cut is None:
                break
            out.append(text[since : cut.start()])
            since = cut.start()
        return [*out, text[since:]]

    def _counts(self, texts: list[str]) -> list[int]:
        if self.is_pieces:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        return [len(e) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        out, held, of, size = [0] * len(texts), [], [], 0
        for k, text in enumerate(texts):
            for piece in self.pieces(text):
                held.append(piece)
                of.append(k)
                size += len(piece)
                if size >= CHARS_AT_ONCE:
                    for i, n in zip(of, self._counts(held), strict=True):
                        out[i] += n
                    held, of, size = [], [], 0
        for i, n in zip(of, self._counts(held) if held else [], strict=True):
            out[i] += n
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each worker process and file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def version(path: str) -> str:
    """The digest of a tokenizer: its file and the rule for contents."""
    with open(path, "rb") as f:
        return hashlib.sha256(f"{RULE}\0{path.rsplit('.', 1)[-1]}\0".encode() + f.read()).hexdigest()


def batches_of(spark: SparkSession, cache: str, of: str) -> list[str]:
    """The folders of the complete batches of counts for one tokenizer."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    where = path(f"{cache}/version={of}")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    found = sorted(x.getPath().toString() for x in files.listStatus(where))
    return [x for x in found if files.exists(path(f"{x}/_SUCCESS"))]


def known(spark: SparkSession, cache: str, of: str) -> DataFrame:
    """digest, n_tokens of all contents that the cache holds for one tokenizer."""
    found = batches_of(spark, cache, of)
    rows = spark.read.schema(CACHE).parquet(*found) if found else spark.createDataFrame([], CACHE)
    return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def with_digests(docs: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """key, n_bytes, digest, text of every document; null texts are empty."""
    own = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    if not counter(path).normalizes:
        return own.select("key", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest"), "text")

    def run(batches: Iterator[pa.RecordBatch]):
        content = counter(path).content
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            sizes, digests = [len(t.encode()) for t in texts], [hashlib.sha256(content(t)).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), batch.column("text")], names=["key", "n_bytes", "digest", "text"])

    return own.mapInArrow(frugal(run), f"key {own.schema['key'].dataType.simpleString()}, n_bytes long, digest binary, text string")


def _encoded(texts: DataFrame, path: str) -> DataFrame:
    """digest, n_tokens of the rows' texts; a digest that a task has met is not encoded again."""

    def run(batches: Iterator[pa.RecordBatch]):
        own, met = counter(path), set()
        for batch in slices(batches, "text", 1_000_000):
            first = {}
            for k, digest in enumerate(batch.column("digest").to_pylist()):
                if digest not in met:
                    met.add(digest)
                    first[k] = digest
            part = batch.column("text").take(pa.array(list(first), pa.int64())).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(list(first.values()), pa.binary()), pa.array(own.counts(part), pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(frugal(run), CACHE)


def counted(docs: DataFrame, path: str, cache: str | None = None, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for every document. cache: a folder that all machines share and that outlives
    the run; without one, counts are cached for this run alone."""
    spark, of = docs.sparkSession, version(path)
    cache = cache or scratch(spark, "token-counts")
    whole = with_digests(docs, path, key, text)
    thin = stored(whole.select("key", "n_bytes", "digest"), "digests")
    contents = thin.groupBy("digest").agg(F.min("key").alias("first"))
    asked = stored(contents.join(known(spark, cache, of), "digest", "left"), "asked")
    misses = asked.filter("n_tokens IS NULL").select(F.col("digest").alias("miss"), "first")
    n_misses, found = misses.count(), asked.filter("n_tokens IS NOT NULL").select("digest", "n_tokens")
    if n_misses:
        some = F.broadcast(misses) if n_misses <= FEW else misses.hint("shuffle_hash")
        texts = whole.join(some, (F.col("digest") == F.col("miss")) & F.col("key").eqNullSafe(F.col("first")), "left_semi")
        batch = scratch(spark, "batch").rsplit("/", 1)[1]
        into = f"{cache}/version={of}/{batch}"
        once = _encoded(texts, path).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))  # of repeated rows
        once.write.parquet(into)
        found = found.unionByName(spark.read.schema(CACHE).parquet(into))
    counts = found.withColumnRenamed("digest", "content")
    met = thin.join(counts, F.col("digest") == F.col("content"), "left")
    return met.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
