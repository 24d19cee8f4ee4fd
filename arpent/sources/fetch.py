"""Fetching pages of an API and approved documents, on the driver before Spark reads the files. The transport is given:
a function from a URL to (status, headers, body), so tests and clusters bring their own."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

Transport = Callable[[str], tuple[int, dict, bytes]]


class FetchError(RuntimeError):
    """A response that cannot be used."""


def https(url: str) -> tuple[int, dict, bytes]:
    """A transport by the standard library; other answers than 200 are told by their status."""
    if urlsplit(url).scheme != "https":
        raise FetchError(f"{url} is not https")
    try:
        with urllib.request.urlopen(url, timeout=60) as answer:
            headers = {k.lower(): v for k, v in answer.headers.items()} | {"x-final-url": answer.geturl()}
            return answer.status, headers, answer.read()
    except urllib.error.HTTPError as problem:
        return problem.code, {}, b""


def get(transport: Transport, url: str, sleep: Callable[[float], None], tries: int = 5, first: float = 1.0, most: float = 30.0) -> tuple[dict, bytes]:
    """Repeat with doubled pauses up to `most` seconds on 429, server and transport errors."""
    for attempt in range(tries):
        try:
            status, headers, body = transport(url)
        except OSError as problem:
            status, headers, body = 0, {}, str(problem).encode()
        if status == 200:
            return headers, body
        if status and status != 429 and status < 500:
            break
        if attempt + 1 < tries:
            sleep(min(most, first * 2**attempt))
    raise FetchError(f"{url}: status {status}")


def pages(transport: Transport, url: str, sleep: Callable[[float], None] = lambda s: None) -> Iterator[list[dict]]:
    """The result lists of a cursor-paged API; a cursor that comes again would never end and is an error."""
    seen = set()
    while url:
        if url in seen:
            raise FetchError(f"no progress at {url}")
        seen.add(url)
        page = json.loads(get(transport, url, sleep)[1])
        yield page.get("results", [])
        url = page.get("next") if page.get("results") else None


def announced_total(transport: Transport, url: str, sleep: Callable[[float], None] = lambda s: None) -> int:
    return int(json.loads(get(transport, url, sleep)[1])["total"])


def document(transport: Transport, url: str, hosts: frozenset[str], known_sha256: str | None = None, most_bytes: int = 25_000_000) -> tuple[str, str, bytes]:
    """(status new, updated or unchanged; sha256; bytes) of an HTML or PDF document from an approved host."""
    parts = urlsplit(url)
    if parts.scheme != "https" or parts.hostname not in hosts:
        raise FetchError(f"{url} is not approved")
    headers, body = get(transport, url, lambda s: None)
    kind = headers.get("content-type", "").split(";")[0].strip().lower()
    final = urlsplit(headers.get("x-final-url", url))
    if final.scheme != "https" or final.hostname not in hosts:
        raise FetchError(f"{url} leads to a host that is not approved")
    if kind not in ("text/html", "application/xhtml+xml", "application/pdf"):
        raise FetchError(f"{url} is {kind or 'of no type'}")
    if not body or len(body) > most_bytes:
        raise FetchError(f"{url} has {len(body)} bytes")
    if (kind == "application/pdf") != body.startswith(b"%PDF-"):
        raise FetchError(f"{url} is not what its type says")
    sha = hashlib.sha256(body).hexdigest()
    return ("unchanged" if sha == known_sha256 else "updated" if known_sha256 else "new"), sha, body


def _kept(path: str, body: bytes) -> str:
    """Writes beside the file and puts it in place when whole; the checksum."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.part", "wb") as f:
        f.write(body)
    os.replace(f"{path}.part", path)
    return hashlib.sha256(body).hexdigest()


def _sha256(path: str) -> str | None:
    """The checksum of a file, None if there is none."""
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    except FileNotFoundError:
        return None


class Local:
    """Files of this machine, for tests and single machines."""

    kept, sha256 = staticmethod(_kept), staticmethod(_sha256)


class Shared:
    """Files of any store that Spark reads, by its own file systems: what a cluster's other machines can open."""

    def __init__(self, spark: SparkSession):
        self.path, self.conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()

    def kept(self, path: str, body: bytes) -> str:
        """Writes beside the file and puts it in place when whole; the checksum."""
        where, beside = self.path(path), self.path(f"{path}.part")
        files = where.getFileSystem(self.conf)
        out = files.create(beside, True)
        for lo in range(0, len(body), 1 << 22):
            out.write(bytearray(body[lo : lo + (1 << 22)]))
        out.close()
        files.delete(where, False)
        if not files.rename(beside, where):
            raise FetchError(f"{path} could not be put in place")
        return hashlib.sha256(body).hexdigest()

    def sha256(self, path: str) -> str | None:
        """The checksum of a file, None if there is none."""
        where = self.path(path)
        files, digest = where.getFileSystem(self.conf), hashlib.sha256()
        if not files.exists(where):
            return None
        size, file = files.getFileStatus(where).getLen(), files.open(where)
        for lo in range(0, size, 1 << 22):
            digest.update(bytes(file.readNBytes(min(1 << 22, size - lo))))
        file.close()
        return digest.hexdigest()


def acquired_years(transport: Transport, urls: dict[int, str], folder: str, known: dict[int, str] | None = None, sleep: Callable[[float], None] = lambda s: None, files: Local | Shared = Local()) -> dict[int, tuple[str, str, str]]:
    """(path, sha256, reused or downloaded) of each year's gzip file, in the folder of a local or a shared store. A file whose checksum is the known one stays; another
    is fetched, read to its end as gzip, and only then put in place."""
    found = {}
    for year, url in sorted(urls.items()):
        path = f"{folder.rstrip('/')}/{year}.csv.gz"
        there = files.sha256(path)
        if there is not None and there == (known or {}).get(year):
            found[year] = path, there, "reused"
            continue
        body = get(transport, url, sleep)[1]
        try:
            with gzip.open(io.BytesIO(body)) as f:
                while f.read(1 << 20):  # to its end, without keeping what is read
                    pass
        except (OSError, EOFError, zlib.error) as problem:
            raise FetchError(f"{url} is no whole gzip file") from problem
        found[year] = path, files.kept(path, body), "downloaded"
    return found


def snapshot_is_valid(folder: str) -> bool:
    """A whole snapshot is there: complete by its manifest, with the checksum and as many rows as that says."""
    try:
        with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
            told = json.load(f)
    except (OSError, ValueError):
        return False
    return bool(told.get("complete")) and told.get("retrieved_rows") == told.get("expected_total") and _sha256(os.path.join(folder, "snapshot.json")) == told.get("sha256")


def acquired_snapshot(transport: Transport, url: str, folder: str, refresh: bool = False, sleep: Callable[[float], None] = lambda s: None) -> str:
    """"reused" or "downloaded": all pages as one snapshot file and a manifest. Fewer or more rows than announced are an
    error, and leave what was there."""
    if not refresh and snapshot_is_valid(folder):
        return "reused"
    expected = announced_total(transport, url, sleep)
    path, digest, n_rows, n_pages = os.path.join(folder, "snapshot.json"), hashlib.sha256(), 0, 0
    os.makedirs(folder, exist_ok=True)
    with open(f"{path}.part", "wb") as f:

        def put(text: str) -> None:
            f.write(text.encode())
            digest.update(text.encode())

        put(f'{{"total": {expected}, "results": [')
        for rows in pages(transport, url, sleep):  # a page at a time
            put("".join((", " if n_rows + k else "") + json.dumps(r, ensure_ascii=False) for k, r in enumerate(rows)))
            n_rows, n_pages = n_rows + len(rows), n_pages + 1
        put("]}")
    if n_rows != expected:
        os.remove(f"{path}.part")
        raise FetchError(f"{url} announced {expected} rows and gave {n_rows}")
    os.replace(f"{path}.part", path)
    told = {"complete": True, "expected_total": expected, "retrieved_rows": n_rows, "page_count": n_pages, "sha256": digest.hexdigest()}
    _kept(os.path.join(folder, "manifest.json"), json.dumps(told).encode())
    return "downloaded"
