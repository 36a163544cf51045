"""WARC archives with a two-level capture index (operator 11).

``write_archives`` writes one WARC record per page, each its own gzip member,
and records where it lies.  ``write_index`` sorts the captures by reversed-host
key (``http://www.a.org/x`` -> ``org,a,www)/x``) into index files of compressed
blocks; each file ends with its sparse directory, one line per block, and a
table of one row per index file names first and last key.  ``lookup`` finds
the file by binary search in that table, the block by binary search in the
file's directory, and reads this block's range alone; ``fetch`` then reads the
records' ranges.

Records of equal payload and at least ``min_bytes`` are written once: the page
with the smallest id is the response, the others are revisits that name it.
Pages are dealt by (digest, one of ``SALTS`` slots of the page), so that a
payload shared by a third of all pages is written by many tasks.

A task names its file by a fresh id and hands the places back as rows; Spark
commits those of one attempt alone, so a lost executor leaves at most a file
that no index names.

Null html is an empty payload, a null url has no target header and the empty
key, a null page_id no id header; null ids come after all others, and of rows
with one payload and one id the smallest url (null first) is the response.
Repeated rows are records of their own.  Control characters of a url are
percent-encoded.  An empty table writes an empty index; other columns are
ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, removed, stored

#: Slots that the rows of one payload are dealt over.
SALTS = 4096
#: Captures in one compressed block of the index.
BLOCK = 1000
#: Date of records whose pages carry none.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_PLACES = "file string, offset long, length long"
CAPTURES = f"key string, page_id long, url string, record_type string, digest string, {_PLACES}"
RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _open(path: str, mode: str):
    """A file of any storage that pyarrow knows; plain paths are local ones."""
    fs, inner = pa.fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (pa.fs.LocalFileSystem(), path)
    if mode == "r":
        return fs.open_input_file(inner)
    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(inner, compression=None)


def _span(path: str, offset: int, length: int) -> bytes:
    with _open(path, "r") as f:
        return f.read_at(length, offset)


def capture_key(url: str | None) -> str:
    """Reversed host, port unless it is the scheme's own, then path and query;
    scheme, user and fragment go.  Text that is no such url is its own key."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?(/[^?#]*)?(\?[^#]*)?", url or "")
    if not m:
        return url or ""
    scheme, host, port, path, query = m.groups()
    host = host.lower().rstrip(".")
    if not host.startswith("[") and not re.fullmatch(r"[0-9.]+", host):
        host = ",".join(reversed(host.split(".")))
    if port and (scheme.lower(), port) not in (("http", "80"), ("https", "443")):
        host += f":{port}"
    return f"{host}){path or '/'}{query or ''}"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda c: f"%{ord(c[0]):02X}", url)


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


# --- records -------------------------------------------------------------------

def record(page_id, url, digest: str, payload: bytes | None, n_bytes: int, refers_to, refers_url, date: str = DATE) -> bytes:
    """One WARC record; without payload a revisit of ``refers_to``."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
            f"Content-Length: {len(http) + len(payload or b'')}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head.append(f"WARC-Profile: {PROFILE}")
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_clean(refers_url)}")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-Id: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + (payload or b"") + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record.  A response's payload must have the length and
    the digest that its headers give."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    n_bytes = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (n_bytes != len(payload) or _base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"payload of page {fields.get('X-Page-Id')} differs from its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_digest": digest,
            "payload_bytes": n_bytes, "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if kind == "response" else None}


# --- archives ------------------------------------------------------------------

def _responses(rows: DataFrame) -> DataFrame:
    """Per (digest, slot) that occurs: the page that is the payload's response."""
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first")
    slots = rows.groupBy("sha1", "slot").agg(first)  # at most SALTS rows per digest
    whole = Window.partitionBy("sha1")
    return slots.select("sha1", "slot", F.min("first").over(whole).alias("first"))


def _write(out: str, min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{out}/warc/{uuid.uuid4().hex}.warc.gz"
        sink, at = None, 0
        try:
            for batch in batches:
                rows = []
                sink = sink or _open(name, "w")
                for r in batch.to_pylist():
                    payload, first = r["html"], r["first"]
                    keeps = len(payload) < min_bytes or (r["nth"] == 1 and first["page_id"] == r["page_id"] and first["url"] == r["url"])
                    digest = _base32(bytes.fromhex(r["sha1"]))
                    raw = record(r["page_id"], r["url"], digest, payload if keeps else None, len(payload), first["page_id"], first["url"])
                    member = gzip.compress(raw, 6, mtime=0)
                    sink.write(member)
                    rows.append((capture_key(r["url"]), r["page_id"], r["url"], "response" if keeps else "revisit", digest, name, at, len(member)))
                    at += len(member)
                yield _batch(rows, CAPTURES)
        finally:
            if sink:
                sink.close()
    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def write_archives(pages: DataFrame, out: str, min_bytes: int = 0) -> DataFrame:
    """Write a record per page under ``out``; returns the captures (key,
    page_id, url, record_type, digest, file, offset, length), stored."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html")).withColumn("slot", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    dealt = rows.join(_responses(rows.drop("html")), ["sha1", "slot"])
    same = Window.partitionBy("sha1", "slot", "page_id", "url").orderBy("page_id")  # repeated rows, counted as they stream by
    dealt = dealt.withColumn("nth", F.row_number().over(same)).select("page_id", "url", "html", "sha1", "first", "nth")
    return stored(dealt.mapInArrow(_write(out, min_bytes), CAPTURES), "captures")


# --- index ---------------------------------------------------------------------

_INDEX = "first_key string, last_key string, index_file string, directory_at long, directory_length long, captures long"


def _write_index(out: str, block: int):
    def line(row: dict) -> bytes:
        return json.dumps([row[c.split()[0]] for c in CAPTURES.split(", ")], ensure_ascii=False).encode() + b"\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{out}/index/{uuid.uuid4().hex}.cdx.gz"
        sink, at, total, directory, waiting, last = None, 0, 0, [], [], None

        def flush():
            nonlocal at, waiting
            data = gzip.compress(b"".join(line(r) for r in waiting), 6, mtime=0)
            sink.write(data)
            directory.append([waiting[0]["key"], at, len(data), len(waiting)])
            at += len(data)
            waiting = []

        try:
            for batch in batches:
                sink = sink or _open(name, "w")
                for row in batch.to_pylist():
                    waiting.append(row)
                    total, last = total + 1, row["key"]
                    if len(waiting) == block:
                        flush()
            if waiting:
                flush()
            if directory:
                data = zlib.compress(json.dumps(directory, ensure_ascii=False).encode())
                sink.write(data)
                yield _batch([(directory[0][0], last, name, at, len(data), total)], _INDEX)
        finally:
            if sink:
                sink.close()
    return run


def write_index(captures: DataFrame, out: str, block: int = BLOCK) -> None:
    """Index files of ``captures`` under ``out``, and the table of these files.
    Captures of one url are dealt by their place too, so a hot url spans files."""
    order = ["key", "file", "offset"]
    rows = captures.repartitionByRange(*order).sortWithinPartitions(*order).select(*[c.split()[0] for c in CAPTURES.split(", ")])
    rows.mapInArrow(_write_index(out, block), _INDEX).write.parquet(f"{out}/index-files")


def _directory(row) -> list[list]:
    return json.loads(zlib.decompress(_span(row["index_file"], row["directory_at"], row["directory_length"])))


def _block(file: str, entry: list) -> list[tuple]:
    return [tuple(json.loads(line)) for line in gzip.decompress(_span(file, entry[1], entry[2])).split(b"\n") if line]


def index_files(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{out}/index-files")


def captures(spark: SparkSession, out: str) -> DataFrame:
    """All captures of an index, block by block."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _batch([(row["index_file"], at, length) for _, at, length, _ in _directory(row)], _PLACES)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _batch(_block(row["file"], [None, row["offset"], row["length"]]), CAPTURES)

    places = index_files(spark, out).repartition("index_file").mapInArrow(blocks, _PLACES)
    return places.repartition("file", "offset").mapInArrow(lines, CAPTURES)


def lookup(spark: SparkSession, out: str, urls: DataFrame) -> DataFrame:
    """Captures of the distinct ``url`` values, by two binary searches each.
    The top level has one row per index file and is handed to every task."""
    top = [r.asDict() for r in index_files(spark, out).orderBy("first_key", "last_key").collect()]  # one row per index file
    shared = spark.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = shared.value
        firsts, lasts = [f["first_key"] for f in files], [f["last_key"] for f in files]
        open_file, directory, heads, open_block, rows = None, None, None, None, None
        for batch in batches:
            for url in batch.column("url").to_pylist():
                key = capture_key(url)
                for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    if open_file != i:
                        open_file, directory, open_block = i, _directory(files[i]), None
                        heads = [d[0] for d in directory]
                    for b in range(max(bisect.bisect_left(heads, key) - 1, 0), bisect.bisect_right(heads, key)):
                        if open_block != (i, b):
                            open_block, rows = (i, b), _block(files[i]["index_file"], directory[b])
                        lo = bisect.bisect_left(rows, key, key=lambda r: r[0])
                        hi = bisect.bisect_right(rows, key, key=lambda r: r[0])
                        found = [r for r in rows[lo:hi] if r[2] == url]
                        if found:
                            yield _batch(found, CAPTURES)

    asked = urls.select(F.col("url").cast("string").alias("url")).distinct()
    return asked.repartitionByRange("url").sortWithinPartitions("url").mapInArrow(run, CAPTURES)


def fetch(found: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of captures, read by range in the order of their places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        try:
            for batch in batches:
                rows, size = [], 0
                for place in batch.to_pylist():
                    if place["file"] != name:
                        if source:
                            source.close()
                        name, source = place["file"], _open(place["file"], "r")
                    got = parse(gzip.decompress(source.read_at(place["length"], place["offset"])))
                    if not with_payload:
                        got["payload"] = None
                    rows.append(tuple(got[c.split()[0]] for c in RECORDS.split(", ")))
                    size += len(got["payload"] or b"")
                    if size > 8_000_000:
                        yield _batch(rows, RECORDS)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, RECORDS)
        finally:
            if source:
                source.close()

    places = found.select("file", "offset", "length")
    return places.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives and index into the shared folder and read every record
    back through the index."""
    spark = pages.sparkSession
    out = new_path(spark, "archives")
    made = write_archives(pages, out, min_bytes)
    write_index(made, out)
    removed(made)
    read = fetch(captures(spark, out), with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
