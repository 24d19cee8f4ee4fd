"""WARC archives: a writer with revisit records and a splittable reader.

Writer: each record is a gzip member of its own. Of records with equal payloads of at least REVISIT_FROM bytes the one
with the largest id is a response; the others become revisit records that refer to it. Every task writes files whose
names hold its attempt, and only files of attempts that Spark accepted get into the manifest that the reader takes, so
lost executors and repeated tasks leave no doubles.

Reader: tasks get byte ranges. A task looks for the gzip magic in its range, decodes the head of every candidate, takes
those that hold a WARC version line and a complete header block as records, and owns the records that start inside its
range, reading beyond its end to finish the last.

Defined results: null payloads are empty payloads; null ids are written and read as null and are never the response of
others unless all ids of a group are null; rows with equal id and payload have equal records; an empty table gives an
archive without files.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arpent.llm.bpe import slices
from arpent.llm.common import stored

#: Payloads of fewer bytes are never revisits.
REVISIT_FROM = 1000
#: Bytes of a reader's range, and of a block that it reads at once.
SPLIT, BLOCK = 32 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    name = "null" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{name}>",
        f"WARC-Date: {datetime(2024, 1, 1, tzinfo=UTC):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {''.join(c for c in url or '' if c.isprintable())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    body = b"" if revisit else payload
    head += [f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def with_revisits(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: a response). Pages are dealt by digest once; the largest ids are
    gathered from digests and ids alone, and only digests that occur twice come to the join."""
    pages = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    large = pages.filter(F.octet_length("payload") >= REVISIT_FROM)
    first = large.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("response_id")), F.col("response_id"))
    return pages.join(first, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write an archive into the folder, which all machines must share; returns the stored manifest: path, bytes, records,
    starts (the places of the records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(folder)
        out, size, starts, path = None, 0, [], ""
        for batch in slices(batches, "payload"):
            for row in batch.to_pylist():
                if out is None:
                    task = TaskContext.get()
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                    path, out = f"{folder}/{name}", store.open_output_stream(f"{root}/{name}", compression=None)
                data = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["refers_to"] is not None)
                out.write(data)
                starts.append(size)
                size += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "records": len(starts), "starts": starts}])

    store, root = open_fs(folder)
    store.create_dir(root, recursive=True)
    manifest = with_revisits(pages, key, url, payload).mapInArrow(run, "path string, bytes long, records long, starts array<long>")
    return stored(manifest, "warc-manifest")


def _head(data: bytes) -> tuple[dict[str, str], int] | None:
    """The header fields and their size, if the decoded start of a member is that of a WARC record."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    version, *lines = data[:end].decode("utf-8", "replace").split("\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines))
    return (fields, end + 4) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


class Member:
    """A gzip member that is decoded block by block from a place in a file."""

    def __init__(self, file, at: int):
        self.file, self.at, self.unzip = file, at, zlib.decompressobj(31)

    def grow(self, most: int) -> bytes:
        out = b""
        while not out and not self.unzip.eof:
            raw = self.unzip.unconsumed_tail
            if not raw:
                self.file.seek(self.at)
                raw = self.file.read(1 << 16)
                self.at += len(raw)
            if not raw:
                raise zlib.error("the file ends inside a member")
            out = self.unzip.decompress(raw, most)
        return out


def try_member(file, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """The record that starts at this place, if one does: header fields, content, end of the member."""
    member, data, end = Member(file, at), bytearray(), -1
    try:
        while end < 0 and not member.unzip.eof:
            seen = max(0, len(data) - 3)
            data += member.grow(1 << 16 if data else 4096)
            if not b"WARC/1.".startswith(data[:7]):
                return None
            end = data.find(b"\r\n\r\n", seen)
        head = _head(bytes(data))
        if head is None:
            return None
        parts = [data]
        while not member.unzip.eof:
            parts.append(member.grow(1 << 20))
    except zlib.error:
        return None
    fields, start = head
    content = b"".join(parts)[start : start + int(fields["content-length"])]
    return (fields, content, member.at - len(member.unzip.unused_data)) if len(content) == int(fields["content-length"]) else None


def records(file, lo: int, hi: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The records that start in [lo, hi), with their places."""
    at, block, base = lo, b"", lo
    while at < hi:
        if not base <= at < base + len(block) - 2:
            file.seek(at)
            base, block = at, file.read(min(BLOCK, hi - at) + len(MAGIC) - 1)
        k = block.find(MAGIC, at - base)
        if k < 0:
            at = base + max(1, len(block) - len(MAGIC) + 1)
            if len(block) < len(MAGIC):
                break
            continue
        at = base + k
        if at >= hi:
            break
        if (found := try_member(file, at)) is None:
            at += 1
            continue
        yield at, found[0], found[1]
        at = found[2]


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").rpartition(":")[2]
    return int(name) if name.lstrip("-").isdigit() else None


def read(spark: SparkSession, files: DataFrame, split: int = SPLIT) -> DataFrame:
    """The records of WARC files (path, bytes): path, at, warc_type, page_id, url, payload, payload_digest (as written),
    payload_bytes (of the full payload), refers_to. Payload of revisits is null. Where the files come with the manifest's
    starts, a range that does not give as many records as start in it is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_fs(row["path"])
                with store.open_input_file(path) as file:
                    out, held, count = [], 0, 0
                    for at, h, content in records(file, row["lo"], row["hi"]):
                        count += 1
                        revisit = h["warc-type"] == "revisit"
                        digest = base64.b32decode(h.get("warc-payload-digest", "sha1:").partition(":")[2]).hex()
                        out.append((row["path"], at, h["warc-type"], _page(h.get("warc-record-id")), h.get("warc-target-uri"), None if revisit else content, digest, int(h["x-payload-length"]) if "x-payload-length" in h else len(content), _page(h.get("warc-refers-to"))))
                        held += len(content)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                            out, held = [], 0
                    if row["wanted"] is not None and count != row["wanted"]:
                        raise ValueError(f"{row['path']}: {count} records from {row['lo']} to {row['hi']}, {row['wanted']} in the manifest")
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names = ["path", "at", "warc_type", "page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("lo")
    places = F.col("starts") if "starts" in files.columns else F.lit(None).cast("array<long>")
    ranges = files.filter("bytes > 0").select("path", "bytes", places.alias("starts"), starts).withColumn("hi", F.least("bytes", F.col("lo") + split))
    own = F.when(F.col("starts").isNotNull(), F.size(F.filter("starts", lambda s: (s >= F.col("lo")) & (s < F.col("hi")))))
    ranges = ranges.select("path", "lo", "hi", own.alias("wanted"))
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    dealt = ranges.repartition(int(min(n, 100_000)), "path", "lo")  # a given number is not coalesced by size
    return dealt.mapInArrow(run, "path string, at long, warc_type string, page_id long, url string, payload binary, payload_digest string, payload_bytes long, refers_to long")


def write_and_read(pages: DataFrame, folder: str, split: int = SPLIT) -> DataFrame:
    """Archive the pages and read the archive back: a row for each record, digests of responses taken from what was read."""
    found = read(pages.sparkSession, write(pages, folder), split)
    digest = F.when(F.col("warc_type") == "response", F.sha1("payload")).otherwise(F.col("payload_digest"))
    size = F.when(F.col("warc_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return found.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), F.col("warc_type").alias("record_type"), "refers_to")

