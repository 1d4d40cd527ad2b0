"""WARC archives as a Spark data source in Python ("warc"), to read and to write.

Reading plans partitions over files, takes predicates on the record type and on header columns into the
scan, parses a record's headers first and inflates its payload only if it is wanted.  Each record that this
writer makes is a gzip member of its own, which carries its length in a gzip extra field (the
"sl" skip-lengths subfield), so a record that a predicate rejects is passed over without inflating it.
Other archives are read as well, plain or gzipped, with any number of records in a member or members in a
record, just not skipped as fast; names of headers are compared without case.  A file that holds anything but
whole records raises an error.

Writing goes to attempt files that the commit moves into place, so a task that is run twice leaves one file.

Cases: a null payload is empty; a null page_id or url is left out of the headers and reads as null;
control characters in a url are percent-encoded; repeated pages are records each, told apart by id and payload
(rows that repeat both share a record id); bodies are returned as they are stored, chunks and content encodings undone
by nobody; an empty table writes no record; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import shared_path, staged

#: Columns taken from headers; predicates on them are answered from the headers alone.
HEADER_COLUMNS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "page_id": "X-Page-Id",
    "payload_bytes": "X-Payload-Length",
}
SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, page_id string, payload_bytes string, headers map<string,string>, payload binary"
WRITTEN = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-31T00:00:00Z"
_HEAD = 1 << 16


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + unquote(path[5:]).lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def member(data: bytes) -> bytes:
    """One gzip member with its own length in the extra field."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 24 + len(body) + 8
    lengths = (size, len(data)) if max(size, len(data)) < 1 << 32 else (0, 0)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, *lengths)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict[str, Any]) -> bytes:
    """A response record with its payload in an HTTP message, or a revisit record without."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + payload
    named = row["page_id"] is not None
    headers = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:page:{row['page_id']}:{row['payload_digest']}>" if named else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row["url"]} {row["payload_digest"]}')}>"), ("WARC-Date", _DATE)]
    if row["url"] is not None:
        headers.append(("WARC-Target-URI", quote(row["url"], safe="%:/?#[]@!$&'()*+,;=-._~")))
    if revisit:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{row['refers_to']}:{row['payload_digest']}>")]
    headers += [("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("X-Payload-Length", str(row["payload_bytes"]))]
    if named:
        headers.append(("X-Page-Id", str(row["page_id"])))
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    """Names as they stand; a line that begins with white space goes on with the one before it."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip()
        if colon:
            out[name] = value.strip()
    return out


@dataclass
class Wanted:
    """Predicates that the headers answer: column or header name -> allowed values or prefix."""

    equal: dict[str, set[str]] = field(default_factory=dict)
    prefix: dict[str, str] = field(default_factory=dict)
    present: set[str] = field(default_factory=set)

    def __call__(self, headers: dict[str, str]) -> bool:
        """``headers`` by lower-case name; names in predicates are in lower case as well."""
        return all(headers.get(k) in v for k, v in self.equal.items()) and all((headers.get(k) or "").startswith(v) for k, v in self.prefix.items()) and all(k in headers for k in self.present)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]):
        super().__init__(paths)
        self.paths = paths


class Plain:
    """The bytes of a file, of which parts can be passed over."""

    def __init__(self, stream: Any):
        self.stream, self.held = stream, bytearray()

    def more(self, size: int) -> bool:
        got = self.stream.read(size)
        self.held += got
        return bool(got)

    def lengths(self) -> tuple[int, int] | None:
        return None

    def skip(self, n: int) -> None:
        if n > len(self.held):
            self.stream.seek(self.stream.tell() + n - len(self.held))
            self.held.clear()
        else:
            del self.held[:n]


class Inflated:
    """The bytes of a file's gzip members, one after the other; a member whose length is stated can be passed over."""

    def __init__(self, stream: Any):
        self.stream, self.held, self.raw, self.inflate = stream, bytearray(), b"", None

    def more(self, size: int) -> bool:
        self.raw = self.raw or self.stream.read(size)
        if not self.raw and self.inflate is None:
            return False
        begun, self.inflate = self.inflate is not None, self.inflate or zlib.decompressobj(31)
        got = self.inflate.decompress(self.raw, size)
        self.held += got
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data, None
        elif begun and not got and not self.raw:
            raise ValueError("a gzip member ends early")
        else:
            self.raw = self.inflate.unconsumed_tail
        return True

    def lengths(self) -> tuple[int, int] | None:
        """At the beginning of a member that states them: (where it ends, its length unpacked)."""
        while True:  # blank lines after a record belong to its member
            while self.held and self.held[0] in b"\r\n":
                del self.held[:1]
            if self.held or self.inflate is None or not self.more(_HEAD):
                break
        if self.held or self.inflate is not None:
            return None
        if len(self.raw) < 24:
            self.raw += self.stream.read(_HEAD)
        if len(self.raw) < 24 or self.raw[3] != 4 or self.raw[12:14] != b"sl":
            return None
        packed, unpacked = struct.unpack("<II", self.raw[16:24])
        return (self.stream.tell() - len(self.raw) + packed, unpacked) if packed else None

    def jump(self, to: int) -> None:
        self.stream.seek(to)
        self.held.clear()
        self.raw, self.inflate = b"", None

    def skip(self, n: int) -> None:
        while n > len(self.held):
            n -= len(self.held)
            self.held.clear()
            if not self.more(1 << 16):
                return
        del self.held[:n]


def _records(source: Plain | Inflated, wanted: Wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(headers as they stand, headers by lower-case name, block) of each record that is wanted, however many a gzip
    member holds.  What is no record raises an error, and so does a record that ends early."""
    while True:
        stated = source.lengths()
        begin = 0
        while True:  # the head; blank lines may stand before it
            while begin < len(source.held) and source.held[begin] in b"\r\n\0":
                begin += 1
            end = source.held.find(b"\r\n\r\n", begin)
            if end >= 0 or not source.more(_HEAD):
                break
        if end < 0:
            if begin < len(source.held):
                raise ValueError("what follows the last record is none")
            return
        head = bytes(source.held[begin:end])
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {head[:20]!r}")
        headers = parse_headers(head)
        by_name = {k.lower(): v for k, v in headers.items()}
        length = int(by_name["content-length"])
        take = wanted(by_name)
        if stated and end + 4 + length + 4 >= stated[1] and not (take and with_payload):
            source.jump(stated[0])  # the member holds this record alone
        else:
            source.skip(end + 4)
            if take and with_payload:
                while len(source.held) < length:
                    if not source.more(1 << 20):
                        raise ValueError("the last record ends early")
                block = bytes(source.held[:length])
            source.skip(length)
        if take:
            yield headers, by_name, block if with_payload else b""


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The body of an HTTP message as it is stored: transfer and content encodings are left as they are."""
    if headers.get("content-type", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.bin_bytes = int(options.get("binbytes", 64 << 20))
        self.wanted = Wanted()
        for name, value in options.items():  # option "header.<Name>": a predicate on any header
            if name.startswith("header."):
                self.wanted.equal[name[7:].lower()] = {value}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = HEADER_COLUMNS.get(f.attribute[0], "").lower() if len(getattr(f, "attribute", ())) == 1 else None
            if column and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted.equal[column] = self.wanted.equal.get(column, values) & values
            elif column and isinstance(f, StringStartsWith) and column not in self.wanted.prefix:
                self.wanted.prefix[column] = f.value
            elif column and isinstance(f, IsNotNull):
                self.wanted.present.add(column)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _fs(self.path)
        infos = [i for i in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if i.is_file and i.base_name.endswith((".warc", ".warc.gz")) and "/_attempts-" not in i.path]
        if fs.get_file_info(root).is_file:
            infos = [fs.get_file_info(root)]
        bins: list[list[str]] = []
        room = 0
        for info in sorted(infos, key=lambda i: i.path):
            if not bins or info.size > room:
                bins.append([])
                room = self.bin_bytes
            bins[-1].append(info.path)
            room -= info.size
        return [Files(tuple(b)) for b in bins] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(self.path)
        columns = [*HEADER_COLUMNS, "headers", "payload"]
        kinds = [*[pa.string()] * len(HEADER_COLUMNS), pa.map_(pa.string(), pa.string()), pa.binary()]
        rows: list[list] = [[] for _ in columns]
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=columns)

        for path in partition.paths:
            with fs.open_input_file(path) as stream:
                packed = stream.read(2) == b"\x1f\x8b"
                stream.seek(0)
                for headers, by_name, block in _records(Inflated(stream) if packed else Plain(stream), self.wanted, self.with_payload):
                    for row, name in zip(rows, HEADER_COLUMNS.values(), strict=False):
                        row.append(by_name.get(name.lower()))
                    rows[-2].append(list(headers.items()))
                    rows[-1].append(payload_of(by_name, block) if self.with_payload else None)
                    held += len(block) + 500
                    if held > 8 << 20:
                        yield flush()
                        rows, held = [[] for _ in columns], 0
        if rows[0]:
            yield flush()


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        #: Of this job alone: other jobs may be writing to the same folder.
        self.attempts = f"_attempts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _fs(self.path)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(f"{root}/{self.attempts}", recursive=True)
                    out = fs.open_output_stream(f"{root}/{self.attempts}/{name}", compression=None)
                out.write(member(record(row)))
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        for message in messages:
            if message is not None and message.name:
                fs.move(f"{root}/{self.attempts}/{message.name}", f"{root}/{message.name}")
        self._drop_attempts(fs, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop_attempts(*_fs(self.path))

    def _drop_attempts(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.attempts}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.attempts}")


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options: payload (true), header.<Name>, binBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, least_bytes: int = 1000) -> None:
    """A record per row of ``pages`` (page_id, url, html).  Of rows with equal payloads of at least
    ``least_bytes``, those with the largest page_id are responses and the others revisit it."""
    register(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # only digests that occur more than once, and written first: where they are few, Spark sees that and moves no payload
    owners = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
    owners = staged(owners.where("n > 1").select("payload_digest", "owner"), "warc-owners")
    joined = rows.join(owners, "payload_digest", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id"))
    out = joined.select("page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("owner")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"))
    out.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per record.

    Responses are measured on their payloads; revisits, whose payloads are not stored, by their headers."""
    register(spark)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+):[0-9a-f]{40}>$", 1).cast("long")
    warc = spark.read.format("warc").load(path)
    response = warc.where("record_type = 'response'").select(F.col("page_id").cast("long"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    heads = spark.read.format("warc").option("payload", "false").load(path)
    revisit = heads.where("record_type = 'revisit'").select(F.col("page_id").cast("long"), F.col("payload_bytes").cast("long"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    return response.unionAll(revisit)


def round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    path = shared_path(pages.sparkSession, "warc")
    write_pages(pages, path, least_bytes)
    return read_pages(pages.sparkSession, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h, n) END AS owner FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN owner IS NOT NULL AND owner IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner IS NOT NULL AND owner IS DISTINCT FROM page_id THEN owner END AS refers_to
FROM r
"""
