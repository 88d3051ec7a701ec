"""WARC: a data source that writes archives and reads them back in sequence.

``df.write.format("warc")`` takes rows of (page_id, url, payload, refers_to) and
writes one record a row, each a gzip member of its own, behind a warcinfo record
at the head of each archive. A task writes into a folder of its job; only the
commit on the driver moves archives to their place, so lost and repeated attempts
leave nothing behind, and jobs that append to one folder do not meet. Overwriting
deletes old archives after the new ones are in place. Archives end after about
``archiveBytes`` bytes.

``spark.read.format("warc")`` gives a partition to each archive. The reader
inflates a piece at a time (zlib), frames records by their content length,
never holds more than one record's block, and checks the block digest, and the
payload digest of responses, where they are stated. A wrong digest or frame
raises an error that names the file and the offset.

Archives of other writers are read too: records of other kinds than responses,
revisits, resources and conversions are passed over; a block that is no HTTP
message is all payload; digests in base 32 or hexadecimal, by SHA-1, SHA-256 or
MD5, are checked, and others are not; where a payload digest or length is not
stated, it is that of the bytes read.

``archive_pages`` marks equal payloads: of those with at least MIN_REVISIT_BYTES
bytes, the largest page_id is the response and the others revisit it. Digests
are grouped with map-side combination and only small rows pass that join; a
payload of a great part of all pages is joined by broadcast.

Defined cases: null html is an empty payload. Very long payloads are one record
each. A null page_id is written without an id and comes back as null; it revisits
a page with an id, and if no equal page has one, all are responses. Repeated rows
with the largest id (a tie) are all responses. An empty table gives no records.
Extra columns are not written, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tomespark.llm.common import join_counted, row_key, session_dir, stash

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 128 << 20
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_PIECE = 1 << 16
_END = b"\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SUFFIX = ".warc.gz"
#: More bytes than this without an end are no headers.
_MOST_HEAD = 1 << 20
_KINDS = ("response", "revisit", "resource", "conversion")


def _file_system(path: str):
    """The file system of a path, and the path within it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _digest(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def _named(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def _member(lines: list[str], body: bytes) -> bytes:
    lines = ["WARC/1.1", *lines, f"WARC-Block-Digest: {_digest(hashlib.sha1(body).digest())}", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + _END) + packer.compress(body) + packer.compress(_END) + packer.flush()


def info(name: str, date: str) -> bytes:
    """The record at the head of an archive."""
    lines = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _member(lines, b"software: tomespark\r\nformat: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record, as a gzip member. A revisit keeps the HTTP headers, with the payload's length, and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = _named(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}')}>"
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    if url is not None:
        plain = re.sub(r"\s", "", url)
        lines.append("WARC-Target-URI: " + plain)
        if plain != url:  # white space would break the line, or be trimmed off it
            lines.append("X-Page-URL: " + json.dumps(url))
    if revisit:
        lines += [f"WARC-Refers-To: {_named(refers_to)}", f"WARC-Profile: {_REVISIT}"]
    lines += [f"WARC-Payload-Digest: {_digest(hashlib.sha1(payload).digest())}", "Content-Type: application/http; msgtype=response"]
    return _member(lines, http if revisit else http + payload)


class _Inflated:
    """The bytes of an archive, inflated a piece at a time and member by member."""

    def __init__(self, stream, name: str) -> None:
        self.stream, self.name, self.member, self.raw, self.held = stream, name, None, b"", bytearray()
        self.offset = self.taken = 0

    def _read(self) -> None:
        self.raw = self.stream.read(_PIECE)
        self.taken += len(self.raw)

    def fail(self, what: str) -> None:
        raise ValueError(f"{self.name}: {what} in the record at byte {self.offset}")

    def begin(self) -> bool:
        """Go to the next member; false at the end of the archive."""
        if not self.raw:
            self._read()
        if not self.raw:
            return False
        self.offset = self.taken - len(self.raw)
        self.member, self.held = zlib.decompressobj(31), bytearray()
        return True

    def more(self) -> bool:
        """Inflate a piece; false when the member has ended."""
        while not self.member.eof:
            if not self.raw:
                self._read()
                if not self.raw:
                    self.fail("the archive ends")
            out = self.member.decompress(self.raw, _PIECE)
            self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if out:
                self.held += out
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while (at := self.held.find(mark)) < 0:
            if len(self.held) > _MOST_HEAD or not self.more():
                self.fail("no end of headers")
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """Exactly ``n`` bytes, as they come."""
        while n:
            if not self.held and not self.more():
                self.fail("the block is short")
            out = bytes(self.held[:n])
            del self.held[: len(out)]
            n -= len(out)
            yield out

    def close(self) -> None:
        """The record's end mark, and nothing after it in the member."""
        while self.more():
            pass
        if self.held != _END:
            self.fail("the end of the record is not where its length says")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass" if b"\xed" in head else "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


class _Checked:
    """Digests of bytes as they pass: SHA-1, and the algorithm that a header states."""

    def __init__(self, stated: str | None) -> None:
        self.kind, _, self.value = (stated or "").partition(":")
        self.kind = self.kind.lower().replace("-", "")
        self.sha1 = hashlib.sha1()
        self.other = hashlib.new(self.kind) if self.kind in ("sha256", "md5") else self.sha1 if self.kind == "sha1" else None

    def update(self, piece: bytes) -> None:
        self.sha1.update(piece)
        if self.other is not None and self.other is not self.sha1:
            self.other.update(piece)

    def wrong(self) -> bool:
        if self.other is None:
            return False
        raw = self.other.digest()
        return self.value.lower() != raw.hex() and self.value.upper().rstrip("=") != base64.b32encode(raw).decode().rstrip("=")

    def stated_sha1(self) -> str | None:
        """The stated SHA-1, in hexadecimal."""
        if self.kind != "sha1":
            return None
        return self.value.lower() if len(self.value) == 40 else base64.b32decode(self.value.upper()).hex()


def read_archive(stream, name: str, with_payload: bool) -> Iterator[tuple]:
    """The records of one archive that hold or stand for a payload, in order."""
    source = _Inflated(stream, name)
    while source.begin():
        head = source.until(_END)
        if not head.startswith(b"WARC/"):
            source.fail("no WARC version")
        fields = _fields(head)
        length = fields.get("content-length", "")
        if not length.isdigit():
            source.fail("no content length")
        kind = fields.get("warc-type", "").lower()
        block, payload, http, kept = _Checked(fields.get("warc-block-digest")), _Checked(fields.get("warc-payload-digest")), bytearray(), bytearray()
        in_payload, size = not fields.get("content-type", "").lower().startswith("application/http"), 0
        for piece in source.pieces(int(length)):
            block.update(piece)
            if not in_payload:
                http += piece
                at = http.find(_END)
                if at < 0:
                    if len(http) > _MOST_HEAD:
                        source.fail("HTTP headers without an end")
                    continue
                piece = bytes(http[at + len(_END) :])
                in_payload, http = True, http[:at]
            payload.update(piece)
            size += len(piece)
            if with_payload:
                kept += piece
        source.close()
        if block.wrong():
            source.fail("wrong block digest")
        if kind not in _KINDS:
            continue
        own = _fields(bytes(http))
        stated = own.get("content-length", "")
        stated = int(stated) if stated.isdigit() and "transfer-encoding" not in own else None
        if kind != "revisit" and "transfer-encoding" not in own and (payload.wrong() or (stated is not None and stated != size)):
            source.fail("wrong payload digest or length")
        url = fields.get("warc-target-uri")
        url = json.loads(fields["x-page-url"]) if "x-page-url" in fields else url.strip("<>") if url is not None else None
        revisit = kind == "revisit"
        digest = payload.stated_sha1() if revisit else payload.sha1.hexdigest()
        yield _page(fields.get("warc-record-id")), url, kind, _page(fields.get("warc-refers-to")), stated if revisit else size, digest, bytes(kept) if with_payload and not revisit else None


@dataclass
class _Archive(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.with_payload = options["path"], options.get("payload", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, folder = _file_system(self.path)
        found = system.get_file_info(fs.FileSelector(folder))
        return [_Archive(x.path) for x in sorted(found, key=lambda x: x.path) if x.base_name.endswith(_SUFFIX) and not x.base_name.startswith((".", "_"))]

    def read(self, partition: _Archive | None) -> Iterator[tuple]:
        if partition is None:  # a folder without archives
            return
        system, _ = _file_system(self.path)
        with system.open_input_stream(partition.path, compression=None, buffer_size=1 << 20) as stream:
            yield from read_archive(stream, partition.path, self.with_payload)


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.most = int(options.get("archiveBytes", options.get("archivebytes", ARCHIVE_BYTES)))
        self.waiting = f"_waiting-{uuid.uuid4().hex}"  # this job's own
        self.date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, folder = _file_system(self.path)
        waiting = f"{folder}/{self.waiting}"
        system.create_dir(waiting, recursive=True)
        names: list[str] = []
        out, size = None, 0
        try:
            for row in iterator:
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}{_SUFFIX}")
                    out, size = system.open_output_stream(f"{waiting}/{names[-1]}", compression=None), 0
                    out.write(info(names[-1], self.date))
                made = record(row["page_id"], row["url"], bytes(row["payload"] or b""), row["refers_to"], self.date)
                out.write(made)
                size += len(made)
                if size >= self.most:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, folder = _file_system(self.path)
        system.create_dir(folder, recursive=True)
        old = [x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.is_file] if self.overwrite else []
        for message in messages:
            for name in message.names if message else ():
                system.move(f"{folder}/{self.waiting}/{name}", f"{folder}/{name}")
        for path in old:
            system.delete_file(path)
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, folder = _file_system(self.path)
        if system.get_file_info(f"{folder}/{self.waiting}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/{self.waiting}")


class WarcDataSource(DataSource):
    """Options: path (a folder), payload (false leaves payloads out when reading), archiveBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)


def archive_pages(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to archives under ``path``."""
    register(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = held.withColumn("row_key", row_key("page_id", "url", "payload"))
    digests = keyed.select("row_key", "page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")).where(F.col("size") >= min_bytes)
    digests = stash(digests, "digests")
    several = digests.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n_rows")).where("n_rows > 1 AND refers_to IS NOT NULL")
    revisits = join_counted(digests, stash(several, "payloads"), ["digest", "size"]).where("page_id IS NULL OR page_id <> refers_to").select("row_key", "refers_to").distinct()
    marked = keyed.join(revisits, "row_key", "left").select("page_id", "url", "payload", "refers_to")
    marked.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``, with SCHEMA."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return os.path.join(session_dir(spark), f"archives-{uuid.uuid4().hex}")
