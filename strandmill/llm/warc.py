"""WARC archives of pages with revisit records, and a two-level capture index to find records in them.

``write_archives`` writes one gzip member per record into archive files, each task its own, named anew by each
attempt, and returns where each record lies; only rows of attempts that succeeded name files that are read later.
Of pages with equal payloads of at least ``min_bytes`` the smallest id is written in full and the others as revisits
of it. The table of payloads that occur more than once is written first, so Spark knows its size when it chooses
between broadcasting it and shuffling the pages.

``build_index`` sorts the captures by reversed-host URL key and page id over all tasks; each task writes its range as
one shard of compressed blocks of ``BLOCK`` captures beside the shard's sparse directory, which has one line per
block. The driver keeps one line per shard. ``lookup`` searches the shards' first keys, the shard's directory and the
block by bisection, and reads just that block; ``read_records`` then reads the records' byte ranges, joined where
they touch. Files are reached through ``pyarrow.fs``, so the root may be a local path, ``file:``, ``s3:``, ``gs:``
or ``hdfs:``.

Defined results: a null html is an empty payload; a null url gets the target ``urn:page:<id>``; white space and
controls in a url are percent-encoded; a null ``page_id`` is never the smallest where another page has the payload
(where all are null, all are responses); rows that repeat the smallest id with its payload are responses too; an
empty table gives no archives, an empty index and an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from dataclasses import dataclass
from math import ceil
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

#: Captures per block of the index, and bytes after which a task begins another archive.
BLOCK, ARCHIVE_BYTES = 1000, 256 << 20
#: Touching records are read in one go up to so many bytes.
READ_BYTES = 4 << 20
#: Bytes of records that a task reads back, about.
TASK_BYTES = 64 << 20
NO_ID = -(1 << 63)
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURES = "url_key string, page_id long, file string, offset long, length long, record_type string"
_odd = re.compile(r"[\s\x00-\x1f\x7f]")


def open_root(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root folder and the folder's path in it."""
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    if re.match(r"^[a-z0-9]+:", uri):
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    return fs.LocalFileSystem(), uri


def target_uri(url: str | None, page_id: int | None) -> str:
    return _odd.sub(lambda m: quote(m[0]), url) if url else f"urn:page:{'' if page_id is None else page_id}"


def url_key(url: str | None, page_id: int | None = None) -> str:
    """The URL with its host's labels reversed and without scheme: ``com,example,www)/path?query``."""
    uri = target_uri(url, page_id)
    try:
        parts = urlsplit(uri)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return uri
    if not host:
        return uri
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "") + (f"#{parts.fragment}" if parts.fragment else "")
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port else ''}){path}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record; a revisit keeps the HTTP header, which names the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target_uri(url, page_id)}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([] if page_id is None else [f"X-Page: {page_id}"]), f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and body of one uncompressed record."""

    def fields(head: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, body = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, fields(http), body


def compress(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0) -> DataFrame:
    """Writes the pages' records under ``root`` and returns their captures, see ``CAPTURES``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    long_enough = F.octet_length("html") >= min_bytes
    first = rows.where(long_enough).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first_id")
    first = written(first, "payloads")
    typed = rows.join(first, "sha", "left").withColumn("revisit", long_enough & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))

    def run(batches):
        system, folder = open_root(root)
        system.create_dir(folder, recursive=True)
        out = name = None
        at = 0
        try:
            for b in batches:
                found = []
                for page_id, url, html, first_id, revisit in zip(*(c.to_pylist() for c in b.columns)):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    data = compress(record(page_id, url, html.encode("utf-8", "replace"), first_id, revisit))
                    out.write(data)
                    found.append((url_key(url, page_id), page_id, name, at, len(data), "revisit" if revisit else "response"))
                    at += len(data)
                if found:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["url_key", "page_id", "file", "offset", "length", "record_type"])
        finally:
            if out is not None:
                out.close()

    return written(typed.select("page_id", "url", "html", "first_id", "revisit").mapInArrow(run, CAPTURES), "captures")


@dataclass
class Index:
    """An index's folder and, in key order, each shard's first capture and name."""

    root: str
    first: list[tuple[str, int]]
    shards: list[str]


def build_index(captures: DataFrame, root: str) -> Index:
    """Writes the index's shards under ``root``; the driver gets one row per shard."""
    ordered = captures.withColumn("_id", F.coalesce("page_id", F.lit(NO_ID)))
    key = ["url_key", "_id", "file", "offset"]
    ordered = ordered.repartitionByRange(*key).sortWithinPartitions(*key).drop("_id")

    def run(batches):
        system, folder = open_root(root)
        system.create_dir(folder, recursive=True)
        name, out, lines, directory, at = f"shard-{uuid.uuid4().hex}", None, [], [], 0

        def close_block():
            nonlocal lines, at
            data = compress("\n".join(json.dumps(x) for x in lines).encode())
            out.write(data)
            directory.append([lines[0][0], NO_ID if lines[0][1] is None else lines[0][1], at, len(data)])
            at, lines = at + len(data), []

        for b in batches:
            for capture in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    out = system.open_output_stream(f"{folder}/{name}.gz", compression=None)
                lines.append(capture)
                if len(lines) == BLOCK:
                    close_block()
        if out is None:
            return
        if lines:
            close_block()
        out.close()
        with system.open_output_stream(f"{folder}/{name}.idx", compression=None) as f:
            f.write("\n".join(json.dumps(x) for x in directory).encode())
        yield pa.record_batch([pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([name])], names=["url_key", "page_id", "shard"])

    columns = ["url_key", "page_id", "file", "offset", "length", "record_type"]
    shards = ordered.select(*columns).mapInArrow(run, "url_key string, page_id long, shard string").collect()
    shards.sort(key=lambda s: (s.url_key, s.page_id))
    return Index(root, [(s.url_key, s.page_id) for s in shards], [s.shard for s in shards])


class Searcher:
    """Finds captures by bisection; keeps the directory and the block that it read last."""

    def __init__(self, index: Index):
        self.index, (self.system, self.folder) = index, open_root(index.root)
        self.shard = self.block = None

    def _directory(self, k: int) -> list[list]:
        if self.shard != k:
            with self.system.open_input_stream(f"{self.folder}/{self.index.shards[k]}.idx", compression=None) as f:
                self.directory = [json.loads(x) for x in f.read().decode().split("\n")]
            self.keys, self.shard = [(x[0], x[1]) for x in self.directory], k
        return self.directory

    def _captures(self, k: int, i: int) -> list[list]:
        if self.block != (k, i):
            _, _, at, size = self._directory(k)[i]
            with self.system.open_input_file(f"{self.folder}/{self.index.shards[k]}.gz") as f:
                self.found = [json.loads(x) for x in zlib.decompress(f.read_at(size, at), 31).decode().split("\n")]
            self.own = [(x[0], NO_ID if x[1] is None else x[1]) for x in self.found]
            self.block = k, i
        return self.found

    def find(self, low: tuple[str, int], high: tuple[str, int]):
        """Captures with ``low <= (key, id) <= high``, in order."""
        k = max(0, bisect_right(self.index.first, (low[0], low[1] - 1)) - 1)
        while k < len(self.index.shards) and self.index.first[k] <= high:
            self._directory(k)
            i = max(0, bisect_right(self.keys, (low[0], low[1] - 1)) - 1)
            while i < len(self._directory(k)) and self.keys[i] <= high:
                captures = self._captures(k, i)
                j = bisect_right(self.own, (low[0], low[1] - 1))
                while j < len(captures) and self.own[j] <= high:
                    yield captures[j]
                    j += 1
                i += 1
            k += 1


def keys_of(pages: DataFrame) -> DataFrame:
    """``(url_key, page_id)`` of pages."""

    def run(batches):
        for b in batches:
            ids, urls = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield pa.record_batch([pa.array([url_key(u, i) for u, i in zip(urls, ids)], pa.string()), b.column(0)], names=["url_key", "page_id"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, "url_key string, page_id long")


def lookup(wanted: DataFrame, index: Index, every_id: bool = False) -> DataFrame:
    """Captures of the distinct ``(url_key, page_id)`` of ``wanted``, or with ``every_id`` of its keys."""
    shared = wanted.sparkSession.sparkContext.broadcast(index)  # one line per shard

    def run(batches):
        searcher = Searcher(shared.value)
        for b in batches:
            found = []
            for key, page_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                one = NO_ID if page_id is None else page_id
                found += searcher.find((key, NO_ID if every_id else one), (key, (1 << 63) - 1 if every_id else one))
            if found:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["url_key", "page_id", "file", "offset", "length", "record_type"])

    keys = wanted.select("url_key", F.lit(None).cast("long").alias("page_id") if every_id else F.col("page_id")).distinct()
    return keys.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id").mapInArrow(run, CAPTURES)


def read_records(captures: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, html`` from the records' byte ranges; html is
    null for revisits. A response whose payload doesn't have its digest is an error."""

    def run(batches):
        system, folder = open_root(root)
        name = source = None
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            found, i = [], 0
            while i < len(rows):
                file, begin, size = rows[i]
                j = i + 1
                while j < len(rows) and rows[j][0] == file and rows[j][1] == begin + size and size < READ_BYTES:
                    size += rows[j][2]
                    j += 1
                if name != file:
                    name, source = file, system.open_input_file(f"{folder}/{file}")
                data = source.read_at(size, begin)
                for _, at, n in rows[i:j]:
                    warc, http, body = parse(zlib.decompress(data[at - begin : at - begin + n], 31))
                    kind, sha = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (digest(body) != sha or len(body) != int(http["Content-Length"])):
                        raise ValueError(f"{file} at {at}: the payload is not the one that was written")
                    refers = warc.get("X-Refers-To-Page")
                    page = warc.get("X-Page")
                    found.append((page and int(page), int(http["Content-Length"]), sha, kind, refers and int(refers), body.decode("utf-8") if kind == "response" else None))
                i = j
            if found:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])

    part = F.floor(F.col("offset") / (16 << 20))
    wanted = captures.select("file", "offset", "length")
    near = (wanted.repartition(tasks, "file", part) if tasks else wanted.repartition("file", part)).sortWithinPartitions("file", "offset")
    return near.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives all pages, indexes them, finds every page through the index and reads its record."""
    root = new_path(spark, "warc")
    captures = write_archives(pages, f"{root}/archives", min_bytes)
    index = build_index(captures, f"{root}/index")
    # by what is read, which the index's rows don't show
    size = captures.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, ceil(size / TASK_BYTES))
    return read_records(lookup(keys_of(pages), index), f"{root}/archives", tasks)
