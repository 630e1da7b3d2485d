"""WARC archives of captures, and their index as globally ordered capture histories.

Writing: one record per page. Of equal payloads of at least MIN_REVISIT bytes the smallest page_id keeps the body
(response); the others refer to it (revisit, identical-payload-digest profile) and carry the HTTP head alone. A record
is header, empty line, block and CRLF CRLF, gzipped as a member of its own, so that offset and length of an index entry
cut it out of its file. Members are written by the text writer, whose line separator is one NUL: zero padding between
members, which gzip readers skip. Files hold about FILE_BYTES of payload each, as rows are dealt over as many
partitions as their bytes need.

Reading: each file is parsed by Content-Length and its payload digests are verified; a file's entries, sorted by URL
key, timestamp and page_id, are one sorted run, stored as Parquet. Merging: runs are dealt by range of that key over as
many tasks as keep RANGE entries each, so a hot URL spreads over tasks. A task keeps its pieces of runs as Arrow
batches and merges them with a loser tree, whose sources decode BUFFER entries at a time. The result is in global order
of its partitions. Archives and runs that nothing reads any more are deleted.

Nulls and edge cases: a null html is an empty payload; a null url gives no WARC-Target-URI and an empty URL key; a row
without page_id is always a response; repeated rows (equal page_id and payload) share their record type, and rows with
the smallest page_id are all responses; an empty table gives no entries; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import delete, discard, map_rows, new_path, spark_schema, staged

MIN_REVISIT = 100
#: Bytes of payload in an archive; entries of a range in the merge, of a range in small indexes, and of a decoded block.
FILE_BYTES, RANGE, SMALL_RANGE, BUFFER = 48 << 20, 400_000, 10_000, 2048
PAD = "\0"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = ("urlkey", "timestamp", "page_id")
ENTRY = pa.schema(
    [("urlkey", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    + [("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)


def with_refers_to(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest and refers_to, dealt over partitions of about FILE_BYTES. Payloads are shuffled once, by page_id; groups of copies never are."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    ids = staged(pages.select("page_id", F.unhex("digest").alias("key"), F.octet_length("html").alias("bytes")), "digests")
    files = max(1, -(-(ids.agg(F.sum("bytes")).first()[0] or 0) // FILE_BYTES))
    known = ids.where((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "key")
    copied = known.groupBy("key").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copied = copied.withColumn("key", F.concat("key", F.lit(b"")))  # dealt anew, so that a hot payload can be split
    revisits = known.join(copied, "key").where("page_id <> refers_to").select("page_id", F.lower(F.hex("key")).alias("digest"), "refers_to")
    revisits = staged(revisits, "revisits").groupBy("page_id", "digest").agg(F.min("refers_to").alias("refers_to"))
    discard(ids)
    return pages.repartition(files, "page_id", "digest").join(revisits, ["page_id", "digest"], "left")


def records(pages: DataFrame) -> DataFrame:
    """The WARC record of each row of with_refers_to(), as ``value``. Captures are dated by page_id, a second apart."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    date = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 31))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.regexp_replace("url", r"[\r\n]", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:x-page:"), text("page_id"), F.lit(">"))),
        line("WARC-Date", date),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:x-page:"), text("refers_to"), F.lit(">"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
    )
    return pages.withColumn("block", block).select(F.concat(header, F.lit(CRLF), F.col("block")).alias("value"))


def gzipped(rows: DataFrame) -> DataFrame:
    """Each value as a gzip member of its own; the string has the member's bytes."""

    def block(values: dict) -> dict:
        out = []
        for value in values["value"]:
            c = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.append(c.compress(value.encode("utf-8", "surrogatepass")) + c.flush())
        return {"value": out}

    return map_rows(rows, block, pa.schema([("value", pa.binary())]), 8 << 20).select(F.col("value").cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT) -> None:
    """Write the pages as WARC files under path."""
    rows = records(with_refers_to(pages, min_bytes)).select(F.concat("value", F.lit(CRLF * 2)).alias("value"))
    gzipped(rows).write.option("lineSep", PAD).option("compression", "none").text(path)


def url_key(url: str | None) -> str:
    """Sort-friendly key: reversed host, port if any, then path and sorted query, in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port else ''}){parts.path or '/'}{f'?{query}' if query else ''}".lower()


def parse(record: bytes, where: str) -> tuple:
    """An ENTRY row without file, offset and length; raises ValueError where the record is broken or its digest differs."""
    head_bytes, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head_bytes.split(b"\r\n")
    if first != b"WARC/1.1":
        raise ValueError(f"no record at {where}")
    head = {}
    for line in lines:
        name, _, value = line.decode("utf-8").partition(":")
        head[name.lower()] = value.strip()
    size = int(head["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"the record at {where} is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    n_bytes = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
    digest, revisit = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"] == "revisit"
    if not revisit and (len(payload) != n_bytes or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of the record at {where} differs from its digest")
    number = lambda x: int(x[12:-1]) if x and len(x) > 13 else None
    url, stamp = head.get("warc-target-uri"), "".join(c for c in head["warc-date"] if c.isdigit())
    return url_key(url), stamp, number(head["warc-record-id"]), url, n_bytes, digest, head["warc-type"], number(head.get("warc-refers-to"))


def members(content: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of the gzip members of a file; padding between them is skipped."""
    at, end = 0, len(content)
    while at < end:
        if content[at] == 0:
            at += 1
            continue
        inflate, parts, pos = zlib.decompressobj(31), [], at
        while not inflate.eof:
            if pos >= end:
                raise ValueError(f"the member at {at} is cut short")
            step = content[pos : pos + (1 << 16)]
            parts.append(inflate.decompress(step))
            pos += len(step)
        pos -= len(inflate.unused_data)
        yield at, pos - at, b"".join(parts)
        at = pos


def order(entry: tuple) -> tuple:
    """Key order with null page_ids first."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0


def batches_of(rows: Iterator[tuple], size: int = BUFFER) -> Iterator[pa.RecordBatch]:
    block: list[tuple] = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), ENTRY.types)], schema=ENTRY)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), ENTRY.types)], schema=ENTRY)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the archives under path, each file's in key order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                name = file.as_py()
                found = ((*parse(record, f"{offset} of {name}"), name, offset, length) for offset, length, record in members(memoryview(content.as_buffer())))
                yield from batches_of(iter(sorted(found, key=order)))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, spark_schema(ENTRY))


def record_of(content: bytes, offset: int, length: int) -> bytes:
    """The record that an index entry points to, from its file's content."""
    return gzip.decompress(content[offset : offset + length])


class LoserTree:
    """K-way merge of sorted iterators; each inner node keeps the loser of its match, so a step plays one path."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources = sources
        self.k = k = max(1, len(sources))
        self.heads: list[tuple | None] = [self.load(i) for i in range(len(sources))] or [None]
        self.losers = [-1] * k
        for i in range(k):
            self.play(i)

    def load(self, i: int) -> tuple | None:
        entry = next(self.sources[i], None)
        return None if entry is None else (order(entry), i, entry)

    def play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            a, b = self.heads[i], self.heads[other]
            if b is not None and (a is None or b[:2] < a[:2]):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.winner]) is not None:
            yield head[2]
            i = self.winner
            self.heads[i] = self.load(i)
            self.play(i)


def entries_of(pieces: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The entries of a run's consecutive pieces, of which BUFFER are decoded at a time."""
    for piece in pieces:
        for at in range(0, piece.num_rows, BUFFER):
            yield from zip(*(c.to_pylist() for c in piece.slice(at, BUFFER).columns))


def sorted_stretches(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, tuple, tuple]]:
    """Slices of a batch that are of one file and in order, with the first and the last key."""
    start, last, file = 0, None, None
    first: tuple | None = None
    for i, (urlkey, stamp, page_id, name) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*KEY, "file")))):
        key = order((urlkey, stamp, page_id))
        if last is not None and (name != file or key < last):
            yield batch.slice(start, i - start), (file, first), (file, last)
            start, first = i, None
        first, last, file = key if first is None else first, key, name
    if last is not None:
        yield batch.slice(start), (file, first), (file, last)


def merge(entries: DataFrame) -> DataFrame:
    """Sorted runs merged into one order by URL key, timestamp and page_id over all partitions."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources: list[list[pa.RecordBatch]] = []
        end = None
        for batch in batches:
            for piece, first, last in sorted_stretches(batch):
                if end is None or first[0] != end[0] or first[1] < end[1]:  # blocks of one run may arrive in any order
                    sources.append([])
                sources[-1].append(piece)
                end = last
        yield from batches_of(iter(LoserTree([entries_of(x) for x in sources])))

    n = entries.count()
    tasks = max(1, -(-n // RANGE), min(-(-n // SMALL_RANGE), 2 * entries.sparkSession.sparkContext.defaultParallelism))
    return entries.repartitionByRange(tasks, *KEY).mapInArrow(merged, spark_schema(ENTRY))


def capture_index(pages: DataFrame, min_bytes: int = MIN_REVISIT, archives: str | None = None) -> DataFrame:
    """Write the pages' archives, read them back, and merge their runs: one ENTRY row per page.

    Archives stay if a folder is given for them; otherwise they are deleted once their entries are stored.
    """
    spark = pages.sparkSession
    path = archives or new_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    found = staged(runs(spark, path), "runs")
    if archives is None:
        delete(spark, path)
    return merge(found)
