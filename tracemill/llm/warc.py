"""WARC archives as a PySpark Python data source (format "warc"), read and written.

Reading: files are planned into partitions of about `partition_bytes`; conditions on the record type and other header
columns (read_warc's `where`) are pushed into the reader; a record's headers are parsed first, and where they fail the filters, or payloads are
not wanted (option payload=false), its payload is skipped without being decompressed: records written here are gzip
members whose extra field `sl` has their length, so the reader steps over the rest. Members without it, and plain .warc
files, are read too.

Writing: each task writes part files of about `file_bytes` under names of its own; the commit on the driver gives the
final names, so a lost executor's files never count. The folder must be one that all nodes reach (a file:// path, or
any address that pyarrow's file systems open).

Defined cases: an empty folder or table gives no records; a null payload is written as an empty one; header values that
are null are left out and read as null. Repeated rows are records of their own. Only the named columns of pages are read, so
others may have any name. Blank lines after the last record of a plain file are no record. A file that is damaged (cut
within a record, or no WARC record where one should begin) raises Damaged, a ValueError that names the file and the byte
where the record begins; with damaged="skip" the records before that place count and the rest of the file is left out."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from tracemill.llm.base import shared_dir, written

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_bytes bigint, digest_ok boolean, payload binary"
#: Columns that come from a record's headers, by header name.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
ROWS = 256
#: Bytes of a gzip member or of a plain record read at first; more are read until the headers are whole.
HEAD = 2048


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(row: dict) -> bytes:
    """A WARC record. payload_digest is the bare base32 value; payload_bytes is the full payload's, also in a revisit."""
    payload = row["payload"] or b""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = head + (payload if row["record_type"] != "revisit" else b"")
    values = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Target-URI": row["target_uri"], "WARC-Date": row["warc_date"] or EPOCH,
        "WARC-Payload-Digest": row["payload_digest"] and f"sha1:{row['payload_digest']}", "WARC-Refers-To": row["refers_to"], "WARC-Profile": REVISIT if row["record_type"] == "revisit" else None,
        "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in values.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member with its own and the data's length in the extra field `sl`."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 12 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Damaged(ValueError):
    """A file that does not hold whole WARC records."""


def parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise Damaged(f"no WARC record: {lines[0][:40]!r}")
    found = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}
    if not found.get("content-length", "").isdigit():
        raise Damaged("it does not state its content's length")
    return found


class Stream:
    """A file read forwards in large steps; skipping moves ahead without reading. `record` is where the last record began."""

    def __init__(self, file):
        self.file, self.held, self.at, self.record = file, b"", 0, 0
        self.total = file.seek(0, 2)
        file.seek(0)

    def place(self) -> int:
        return self.file.tell() - (len(self.held) - self.at)

    def need(self, n: int) -> None:
        """Damaged, unless n more bytes are there."""
        if self.place() + n > self.total:
            raise Damaged("the file ends within it")

    def peek(self, n: int) -> bytes:
        while len(self.held) - self.at < n and (more := self.file.read(max(n, 1 << 20))):
            self.held, self.at = self.held[self.at :] + more, 0
        return self.held[self.at : self.at + n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        ahead = n - (len(self.held) - self.at)
        if ahead <= 0:
            self.at += n
        else:
            self.held, self.at = b"", 0
            self.file.seek(self.file.tell() + ahead)


def _split(data: bytes) -> tuple[bytes, bytes] | None:
    at = data.find(b"\r\n\r\n")
    return None if at < 0 else (data[:at], data[at + 4 :])


def _http(headers: dict[str, str]) -> bool:
    return headers.get("content-type", "").startswith("application/http")


def _inflated(stream: Stream, total: int) -> Iterator[bytes]:
    """A member's data piece by piece, in growing pieces, as far as it is asked for; the stream stays where it is."""
    inflate, read, most = zlib.decompressobj(-15), min(total, HEAD), 1 << 16
    data = stream.peek(read)[24:]
    while True:
        yield inflate.decompress(data, most)
        most *= 2
        data = inflate.unconsumed_tail
        while not data and read < total and not inflate.eof:
            before, read = read, min(total, read * 4)
            data = stream.peek(read)[before:]
            if not data:
                return
        if inflate.eof or not data:
            return


def _gzip_records(stream: Stream, wanted) -> Iterator[tuple[dict, bytes | None]]:
    while start := stream.peek(24):
        stream.record = stream.place()
        if start[:4] == b"\x1f\x8b\x08\x04" and start[12:14] == b"sl" and struct.unpack("<H", start[10:12])[0] == 12:
            stream.need(total := struct.unpack("<I", start[16:20])[0])
            begun = _inflated(stream, total)
            data = next(begun)
            while not (parts := _split(data)) and (more := next(begun, b"")):
                data += more
            if not parts:
                raise Damaged("its headers have no end")
            headers = parsed(parts[0])
            keep, payload = wanted(headers)
            if not keep:
                stream.skip(total)
                continue
            if payload:
                data = zlib.decompress(stream.take(total)[24:-8], -15)
                yield headers, _split(data)[1][: int(headers["content-length"])]
            else:
                block, length = parts[1], int(headers["content-length"])
                while _http(headers) and not _split(block[:length]) and len(block) < length and (more := next(begun, b"")):
                    block += more
                stream.skip(total)
                yield headers, (_split(block[:length]) or (b"", b""))[0] + b"\r\n\r\n"
        else:  # a member of someone else's: its end is only known once it is read
            inflate, data = zlib.decompressobj(31), []
            while not inflate.eof and (more := stream.take(1 << 16)):
                data.append(inflate.decompress(more))
            stream.at -= len(inflate.unused_data)
            parts = _split(b"".join(data))
            if not inflate.eof or not parts:
                raise Damaged("the file ends within it" if not inflate.eof else "its headers have no end")
            headers = parsed(parts[0])
            if len(parts[1]) < int(headers["content-length"]):
                raise Damaged("its content is shorter than stated")
            if wanted(headers)[0]:
                yield headers, parts[1][: int(headers["content-length"])]


def _plain_records(stream: Stream, wanted) -> Iterator[tuple[dict, bytes | None]]:
    while True:
        while stream.peek(1) in (b"\r", b"\n"):  # after the record before, or at the end
            stream.skip(1)
        if not stream.peek(1):
            return
        stream.record, read = stream.place(), HEAD
        while not (parts := _split(stream.peek(read))) and len(stream.peek(read)) == read:
            read *= 4
        if not parts:
            raise Damaged("its headers have no end")
        headers = parsed(parts[0])
        stream.skip(len(parts[0]) + 4)
        stream.need(length := int(headers["content-length"]))
        keep, payload = wanted(headers)
        if keep and payload:
            yield headers, stream.take(length)
        else:
            if keep:
                read = min(length, HEAD)
                while _http(headers) and not _split(stream.peek(read)) and read < length and len(stream.peek(read)) == read:
                    read = min(length, read * 4)
                yield headers, (_split(stream.peek(read)) or (b"", b""))[0] + b"\r\n\r\n"
            stream.skip(length)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.bytes = int(options.get("partition_bytes", 32 << 20))
        self.skip_damaged = options.get("damaged", "fail") == "skip"
        self.push = {c: frozenset(v) for c, v in json.loads(options.get("push", "{}")).items() if c in HEADERS}
        self.filters: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        """Takes the filters that option `push` announces; they are on every frame made from this relation."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in self.push and self.push[column] == frozenset(f.value if isinstance(f, In) else [f.value]):
                self.filters.append((column, self.push[column]))
            else:
                yield f

    def partitions(self):
        system, path = opened(self.path)
        found = [f for f in system.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True)) if f.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path)]
        plan, room = [], 0
        for f in sorted(found, key=lambda f: f.path):
            if not plan or f.size > room:
                plan.append(Files([]))
                room = self.bytes
            plan[-1].paths.append(f.path)
            room -= f.size
        return plan or [Files([])]

    def _row(self, headers: dict, block: bytes) -> tuple:
        value = {c: headers.get(h) for c, h in HEADERS.items()}
        if value["payload_digest"]:
            value["payload_digest"] = value["payload_digest"].removeprefix("sha1:")
        http, body = _split(block) or (b"", block)
        if not headers.get("content-type", "").startswith("application/http"):
            http, body = b"", block
        stated = re.search(rb"(?mi)^content-length:\s*(\d+)", http)
        whole = self.payload and value["record_type"] != "revisit"
        size = int(stated[1]) if stated else len(body) if whole else None
        right = base32_sha1(body) == value["payload_digest"] if whole and value["payload_digest"] else None
        return (*value.values(), size, right, body if whole else None)

    def _records(self, path: str, stream: Stream, wanted) -> Iterator[tuple[dict, bytes | None]]:
        try:
            yield from (_gzip_records if path.endswith(".gz") else _plain_records)(stream, wanted)
        except (Damaged, zlib.error) as e:
            if not self.skip_damaged:
                raise Damaged(f"{path}: the WARC record at byte {stream.record} is damaged: {e}") from e

    def read(self, partition: Files):
        def wanted(headers: dict) -> tuple[bool, bool]:
            for column, allowed in self.filters:
                found = headers.get(HEADERS[column])
                if column == "payload_digest" and found:
                    found = found.removeprefix("sha1:")
                if found not in allowed:
                    return False, False
            return True, self.payload

        schema = pa.schema([(c, pa.string()) for c in HEADERS] + [("payload_bytes", pa.int64()), ("digest_ok", pa.bool_()), ("payload", pa.binary())])
        rows: list[tuple] = []
        system = opened(self.path)[0]
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for headers, block in self._records(path, Stream(file), wanted):
                    rows.append(self._row(headers, block))
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("file_bytes", 64 << 20))
        self.level = int(options.get("level", 1))

    def write(self, iterator):
        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        names, file, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if file is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    file, size = system.open_output_stream(f"{path}/.{names[-1]}.tmp"), 0
                data = member(record(row), self.level)
                file.write(data)
                size += len(data)
                if size >= self.bytes:
                    file.close()
                    file = None
        if file is not None:
            file.close()
        return Written(names)

    def commit(self, messages):
        system, path = opened(self.path)
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{path}/.{name}.tmp", f"{path}/{name}")

    def abort(self, messages):
        system, path = opened(self.path)
        for m in messages:
            for name in m.names if m else []:
                if system.get_file_info(f"{path}/.{name}.tmp").type == pafs.FileType.File:
                    system.delete_file(f"{path}/.{name}.tmp")


class WarcSource(DataSource):
    """spark.read.format("warc").option("path", ...) and df.write.format("warc").mode("append")."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True, where: dict[str, list[str]] | None = None, damaged: str = "fail") -> DataFrame:
    """Records of a folder. where: for header columns the values that are wanted, as in
    {"record_type": ["response"]}; these conditions are pushed into the reader. Conditions that are put on the result
    later are not: Spark 4.1 keeps the pushed filters of a loaded relation for all frames made from it, so a second
    frame would see the first one's filters. Those of `where` are the same for all. damaged: "fail" or "skip"."""
    register(spark)
    where = {c: sorted(v) for c, v in (where or {}).items()}
    if odd := set(where) - set(HEADERS):
        raise ValueError(f"no header columns: {sorted(odd)}")
    rows = spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).option("push", json.dumps(where)).option("damaged", damaged).load()
    for column, values in where.items():
        rows = rows.where(F.col(column).isin(*values) if values else F.lit(False))
    return rows


def write_warc(records: DataFrame, path: str) -> None:
    """records has record_id, record_type, target_uri, payload_digest (bare base32), refers_to, payload_bytes, payload."""
    register(records.sparkSession)
    columns = ["record_id", "record_type", "target_uri", F.lit(None).cast("string").alias("warc_date"), "payload_digest", "refers_to", "payload_bytes", "payload"]
    records.select(*columns).write.format("warc").option("path", path).mode("append").save()


def base32(hexadecimal: str) -> str:
    """SQL: the base32 text of the 20 bytes that a hexadecimal text of 40 digits gives."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return f"array_join(transform(sequence(0, 31), k -> substr('{digits}', 1 + cast(shiftright(cast(conv(substr({hexadecimal}, 5 * (k div 4) + 1, 5), 16, 10) as bigint), 15 - 5 * cast(k % 4 as int)) % 32 as int), 1)), '')"


def revisits(pages: DataFrame, key: str = "page_id", uri: str = "url", text: str = "html", least_bytes: int = 0) -> DataFrame:
    """Records to write for pages: of equal payloads of at least least_bytes the smallest page is the response, rows of
    other pages revisit it. Rows that repeat the smallest page are responses too, as are all if every id is null."""
    read = pages.select(F.col(key).cast("bigint").alias("page"), F.col(uri).cast("string").alias("target_uri"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("payload"))
    read = read.select("*", F.length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("sha1"))
    groups = read.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1").agg(F.count("*").alias("n"), F.min("page").alias("least"))
    groups = written(groups.where("n > 1 and least is not null").select("sha1", "least"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    again = (F.col("least") != F.col("page")) | (F.col("least").isNotNull() & F.col("page").isNull())
    joined = read.join(groups, "sha1", "left").withColumn("again", F.coalesce(again, F.lit(False)))
    return joined.select(
        F.coalesce(urn(F.col("page")), F.lit("<urn:page:>")).alias("record_id"), F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.expr(base32("sha1")).alias("payload_digest"), F.when(F.col("again"), urn(F.col("least"))).alias("refers_to"), "payload_bytes", F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )


def archived(pages: DataFrame) -> DataFrame:
    """Write pages as WARC files in the shared folder and read them back: a row for each page."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(revisits(pages), path)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>', 1) as bigint)")
    return read_warc(spark, path).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "digest_ok")
