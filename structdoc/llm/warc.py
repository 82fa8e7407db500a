"""WARC archives as a Spark data source: a writer of one gzip member for each record, a splittable reader.

A read task owns the members that start inside its byte range. It looks for gzip magic from the
range's start, takes a candidate only if it decodes to a WARC header, reads on from member to member,
past the range's end for the last one, and looks for magic again behind bytes that don't decode.
Files are reached by pyarrow's file systems, so a path may be a URI of any store they know.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from structdoc.llm.common import keyed_join, shared_path, written

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
#: Compressed bytes that are decoded at a time.
PIECE = 1 << 14
#: Compressed bytes that are decoded to see whether a candidate is a record.
HEAD = 1 << 12
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
FIELDS = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload")
ARROW = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in FIELDS])
DAMAGED = (None, "damaged", None, None, None, None, None)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member; of a revisit only the HTTP header is kept, with the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri) if uri else record_id
    head = {
        "WARC-Type": "revisit" if refers_to else "response",
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": safe,
        "WARC-Payload-Digest": f"sha1:{digest}",
        **({"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": PROFILE} if refers_to else {}),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


class Tail:
    """A file read in blocks from a position on, with as much looked ahead as asked."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.data, self.used = file, at, b"", 0
        self.size = file.size()

    def need(self, n: int) -> bytes:
        """The next n bytes, fewer at the end of the file."""
        while len(self.data) - self.used < n and self.at + len(self.data) - self.used < self.size:
            self.file.seek(self.at + len(self.data) - self.used)
            self.data, self.used = self.data[self.used :] + self.file.read(BLOCK), 0
        return self.data[self.used : self.used + n]

    def skip(self, n: int) -> None:
        self.used, self.at = self.used + len(self.need(n)), self.at + n

    def find(self, mark: bytes) -> int:
        """Where the mark stands in what is looked ahead, -1 if not there; at least len(mark) bytes unless the file ends."""
        self.need(len(mark))
        found = self.data.find(mark, self.used)
        return found - self.used if found >= 0 else -1


def is_record(head: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(head, 16).startswith(b"WARC/")
    except zlib.error:
        return False


def seek_record(tail: Tail, end: int) -> bool:
    """Moves to the next byte before end at which a record's member starts."""
    while tail.at < end:
        found = tail.find(MAGIC)
        if found < 0:
            ahead = len(tail.data) - tail.used
            if ahead < len(MAGIC):
                return False
            tail.skip(ahead - len(MAGIC) + 1)
            continue
        tail.skip(found)
        if tail.at >= end:
            return False
        if is_record(tail.need(HEAD)):
            return True
        tail.skip(1)
    return False


def members(file: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """The decoded members that start in [start, end); of a damaged one what could be decoded, cut so that it parses as damaged."""
    tail = Tail(file, start)
    while seek_record(tail, end):
        first, unpack, out = tail.at, zlib.decompressobj(31), []
        try:
            while not unpack.eof:
                data = tail.need(PIECE)
                if not data:
                    raise zlib.error("cut off")
                out.append(unpack.decompress(data))
                tail.skip(len(data) - len(unpack.unused_data))
                if unpack.eof:
                    break
        except zlib.error:  # a damaged member: go on behind its magic
            yield b"WARC/"
            tail = Tail(file, first + 1)
            continue
        yield b"".join(out)


def parse_records(data: bytes) -> Iterator[tuple]:
    """The records of a member as rows of SCHEMA; a header without its end or with a length that is no number gives a row of the type ``damaged``, and ends the member."""
    at = 0
    while data.startswith(b"WARC/", at):
        cut = data.find(b"\r\n\r\n", at)
        if cut < 0:
            yield DAMAGED
            return
        lines = data[at:cut].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        if not re.fullmatch(r"\d*", head.get("content-length") or "", re.ASCII):
            yield DAMAGED
            return
        size = int(head.get("content-length") or 0)
        block = data[cut + 4 : cut + 4 + size]
        at = cut + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2
        bare = lambda k: head[k].strip("<>") if k in head else None
        kind, digest = head.get("warc-type"), head.get("warc-payload-digest", "").rpartition(":")[2] or None
        payload, length = block, len(block)
        if head.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
            length = int(told[1]) if told and kind == "revisit" else len(payload)
        if kind != "revisit":
            digest = payload_digest(payload)
        yield bare("warc-record-id"), kind, head.get("warc-target-uri"), bare("warc-refers-to"), digest, length, payload


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes") or options.get("splitBytes") or 16 << 20)
        self.payload = str(options.get("payload", "true")).lower() != "false"

    def partitions(self) -> list[ByteRange]:
        store, path = open_store(self.path)
        found = store.get_file_info(path)
        files = [found] if found.is_file else [x for x in store.get_file_info(pafs.FileSelector(path)) if x.is_file and x.path.endswith((".warc.gz", ".warc"))]
        if plain := [x.path for x in files if x.path.endswith(".warc")]:
            raise ValueError(f"archives must have a gzip member for each record: {plain[:3]}")
        ranges = [ByteRange(x.path, at, min(at + self.split, x.size)) for x in sorted(files, key=lambda x: x.path) for at in range(0, x.size, self.split)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if part.start >= part.end:
            return
        store, _ = open_store(self.path)
        with store.open_input_file(part.path) as file:
            rows, held = [], 0
            for data in members(file, part.start, part.end):
                for row in parse_records(data):
                    rows.append(row if self.payload else (*row[:-1], None))
                    held += len(data) if self.payload else 0
                if len(rows) >= 5000 or held > 8 << 20:
                    yield pa.record_batch(list(map(pa.array, zip(*rows, strict=True), ARROW.types)), schema=ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch(list(map(pa.array, zip(*rows, strict=True), ARROW.types)), schema=ARROW)


@dataclass
class Part(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows (record_id, uri, payload, refers_to); a task's file gets its final name when the job commits."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        store, path = open_store(self.path)
        store.create_dir(path)
        name, out = f"{path}/_{uuid.uuid4().hex}", None
        try:
            for batch in batches:
                cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("record_id", "uri", "payload", "refers_to")]
                out = out or store.open_output_stream(name)
                for record_id, uri, payload, refers_to in zip(*cols, strict=True):
                    out.write(encode_record(record_id, uri, payload or b"", payload_digest(payload or b""), refers_to, self.date))
        finally:
            if out:
                out.close()
        return Part([name] if out else [])

    def commit(self, messages: list[Part | None]) -> None:
        store, path = open_store(self.path)
        store.create_dir(path)
        for i, name in enumerate(x for m in messages if m for x in m.files):
            store.move(name, f"{path}/part-{i:05d}-{name.rpartition('_')[2]}.warc.gz")

    def abort(self, messages: list[Part | None]) -> None:
        store, _ = open_store(self.path)
        for name in (x for m in messages if m for x in m.files):
            store.delete_file(name)


class WarcSource(DataSource):
    """spark.read.format("warc"): options path, splitBytes, payload (false leaves payloads out)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Archives pages(page_id, url, html, ...), a record for each row; null html is an empty payload.

    Of equal payloads of at least min_revisit_bytes the record with the smallest page_id is a
    response and the others are revisits of it; smaller payloads are all responses. Rows that repeat the
    smallest page_id are all responses, as are rows with a null page_id if no equal payload has one.
    An empty table gives an empty folder; other columns are ignored.
    """
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    digests = rows.select("page_id", F.unhex(F.sha1("payload")).alias("digest"), F.length("payload").alias("bytes"))
    equal = digests.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("rows")).where("rows > 1")
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    marked = keyed_join(rows, written(equal, "equal-pages"), ["digest"], "rows", F.coalesce("page_id", F.lit(0)))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    revisit = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    spark.dataSource.register(WarcSource)
    out = marked.select(urn(F.col("page_id")).alias("record_id"), F.col("url").alias("uri"), "payload", F.when(revisit, urn(F.col("first_page"))).alias("refers_to"))
    out.write.format("warc").mode("append").option("path", path).save()


def read_warc(spark: SparkSession, path: str, payload: bool = True, split_bytes: int = 16 << 20) -> DataFrame:
    """The records of the archives at path: record_id, record_type, target_uri, refers_to, payload_digest, payload_bytes, payload.

    A member that can't be decoded, or whose header is malformed, is a row with the type ``damaged`` and nulls. Archives
    that aren't compressed are an error.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("splitBytes", str(split_bytes)).option("payload", str(payload).lower()).load(path)


def archive_pages(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes pages to archives and reads these back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_warc(pages, path, min_revisit_bytes)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS BIGINT)")
    return read_warc(spark, path, payload=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
