"""WARC archives as a Python data source (format name ``warc``).

Writing: each task writes one archive of gzip members, one record each, under a name of its
attempt; the driver's commit lists the files that count in a manifest, so that retried tasks
leave nothing visible twice, and where they can be split.  Each member carries the skip lengths
of the WARC standard (extra field ``sl``: compressed and full size), so a reader can seek over a
record without inflating.

Reading: any ``.warc`` or ``.warc.gz`` file, or a folder of them; a manifest is used where there
is one.  Files are planned into partitions by size, files of a manifest by ranges of records.  A
record's headers are parsed first; pushed-down predicates on record type, record id and target URI
are decided on them, and the rest of an unwanted record is skipped: by a seek in uncompressed
files and where skip lengths are given, else by inflating without decoding.  Only columns in the
read schema are made: without a payload column no payload is decoded.  Text between records that
is no record, and records without a length, are passed over up to the next record.  A damaged gzip
member costs its own record; reading goes on at the next member, and a column `damage` in the
read schema adds a row that names the file and offset of each.

Files go through pyarrow's file systems, which cover local, HDFS and object stores by URI.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from fernlake.llm import textkernel as tk
from fernlake.plans.scratch import Scratch
from fernlake.plans.skew import dealt_anew

WRITE_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
READ_SCHEMA = WRITE_SCHEMA + ", stored_bytes long, stored_sha256 string, headers map<string,string>"
MANIFEST = "_manifest.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = 4096
_BLOCK = 1 << 20
_LONGEST_HEAD = 1 << 22
_MARK = re.compile(rb"WARC/\d")


def _clean(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _member(record: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def _record(row: dict) -> bytes:
    payload = row["payload"] or b""
    kind = row["record_type"] or "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {_clean(kind)}"]
    for name, key in (("WARC-Record-ID", "record_id"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to")):
        if row[key] is not None:
            head.append(f"{name}: {_clean(row[key])}")
    if row["payload_digest"] is not None:
        head.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    head.append(f"WARC-Payload-Length: {row['payload_bytes']}")
    if kind == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    size: int
    marks: list  # offsets of records, one for each stretch of about `mark` bytes


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, level: int, mark: int = 1 << 22):
        self.path, self.level, self.mark = path, level, mark

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        name, out, size, marks = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, [0]
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None:
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    if size - marks[-1] >= self.mark:
                        marks.append(size)
                    member = _member(_record(row), self.level)
                    out.write(member)
                    size += len(member)
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(f"{root}/{name}")
            raise
        if out is not None:
            out.close()
        return _Written(name if out is not None else None, size, marks)

    def commit(self, messages) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        files = sorted((m.file, m.size, m.marks) for m in messages if m is not None and m.file)
        with store.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{root}/{m.file}")


@dataclass
class _Files(InputPartition):
    """Ranges (file, first byte, end byte or None) that one task reads; a range begins at a record."""

    ranges: list

    def __init__(self, ranges: list):
        self.ranges = ranges


def _listed(store, root: str) -> list[tuple[str, int, list]]:
    """(file, size, offsets where it can be split) of an archive folder or file."""
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size, [0])]
    manifest = f"{root}/{MANIFEST}"
    if store.get_file_info(manifest).type == fs.FileType.File:
        with store.open_input_stream(manifest, compression=None) as src:
            return [(f"{root}/{name}", size, marks) for name, size, marks in json.loads(src.read())]
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((x.path, x.size, [0]) for x in found if x.type == fs.FileType.File and x.path.lower().endswith((".warc", ".warc.gz")))


class WarcReader(DataSourceReader):
    COLUMNS = ("record_type", "record_id", "target_uri")

    def __init__(self, path: str, schema: StructType, split_bytes: int):
        self.path, self.schema, self.split_bytes = path, schema, split_bytes
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in self.COLUMNS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self):
        store, root = fs.FileSystem.from_uri(self.path)
        out, now, held = [], [], 0
        for name, size, marks in _listed(store, root):
            for first, end in zip(marks, [*marks[1:], size], strict=True):
                if now and held + end - first > self.split_bytes:
                    out.append(_Files(now))
                    now, held = [], 0
                if now and now[-1][0] == name and now[-1][2] == first:
                    now[-1] = (name, now[-1][1], end)
                else:
                    now.append((name, first, end))
                held += end - first
        return out + [_Files(now)] if now else out or [_Files([])]

    def read(self, partition):
        store, _ = fs.FileSystem.from_uri(self.path)
        names = self.schema.fieldNames()
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(self.schema)
        rows, held = [], 0
        for file, first, end in partition.ranges:
            with store.open_input_file(file) as src:
                for row in _records(src, self.wanted, names, first, end, file):
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 200
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, kind)


class _Bytes:
    """A range of a seekable file, read in blocks; a skip beyond the block is a seek."""

    def __init__(self, src, first: int, end: int):
        self.src, self.at, self.end, self.block, self.base = src, first, end, b"", first

    def peek(self, n: int) -> bytes:
        """The next n bytes, fewer at the end."""
        n = min(n, self.end - self.at)
        inside = self.at - self.base
        if inside + n > len(self.block):
            self.src.seek(self.at)
            self.base, inside = self.at, 0
            self.block = self.src.read(min(max(n, _BLOCK), self.end - self.at))
        return self.block[inside : inside + n]

    def read(self, n: int) -> bytes:
        out = self.peek(n)
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        self.at = min(self.end, self.at + n)

    def part(self, n: int) -> _Bytes:
        """The next n bytes as a range of their own."""
        out = _Bytes(self.src, self.at, min(self.end, self.at + n))
        out.block, out.base = self.block, self.base
        return out


class _Inflated:
    """The text of gzip members one after another, with the calls of _Bytes; the first pieces are small, for headers alone."""

    def __init__(self, raw: _Bytes):
        self.raw, self.ready, self.inflate, self.step = raw, bytearray(), None, 1 << 11
        self.member, self.whole = raw.at, 0  # where the member begins; bytes ready before it
        self.damage: list[int] = []
        self.stopped = False

    def _more(self) -> bool:
        if self.stopped:
            return False
        if self.inflate is None:
            if not self.raw.peek(1):
                return False
            self.inflate = zlib.decompressobj(31)
            self.member, self.whole = self.raw.at, len(self.ready)
        piece = self.raw.read(self.step)
        if not piece:
            return False
        self.step = min(2 * self.step, 1 << 16)
        try:
            self.ready += self.inflate.decompress(piece)
        except zlib.error:
            # what the damaged member gave goes; nothing more is read before resume()
            self.damage.append(self.member)
            del self.ready[max(0, self.whole) :]
            self.inflate, self.stopped, self.raw.at = None, True, self.member + 1
            _seek_member(self.raw)
            return False
        if self.inflate.eof:
            self.raw.at -= len(self.inflate.unused_data)
            self.inflate = None
            while self.raw.peek(1) == b"\0":  # padding
                self.raw.skip(1)
        return True

    def peek(self, n: int) -> bytes:
        while len(self.ready) < n and self._more():
            pass
        return bytes(self.ready[:n])

    def _used(self, n: int) -> None:
        del self.ready[:n]
        self.whole -= n

    def read(self, n: int) -> bytes:
        out = self.peek(n)
        self._used(len(out))
        return out

    def skip(self, n: int) -> None:
        while n > 0 and (self.ready or self._more()):
            gone = min(n, len(self.ready))
            self._used(gone)
            n -= gone

    def resume(self) -> list[int]:
        """Go on behind damage; the offsets of the damaged members."""
        found, self.damage, self.stopped = self.damage, [], False
        return found


def _seek_member(raw: _Bytes) -> None:
    """Skip to the next mark of a gzip member, or to the end."""
    while block := raw.peek(_BLOCK):
        at = block.find(b"\x1f\x8b\x08")
        if at >= 0:
            raw.skip(at)
            return
        raw.skip(max(1, len(block) - 2))


def _skip_lengths(lead: bytes) -> int | None:
    """Compressed size of a member that gives its skip lengths first, else None."""
    if lead[:4] == b"\x1f\x8b\x08\x04" and lead[12:14] == b"sl" and len(lead) >= 24:
        return struct.unpack("<I", lead[16:20])[0]
    return None


def _headers(text: str) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """Header lines as pairs and by lower-case name; lines without a colon are left out, indented ones continue."""
    pairs: list[tuple[str, str]] = []
    for line in text.replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and pairs:
            pairs[-1] = (pairs[-1][0], f"{pairs[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            pairs.append((name.strip(), value.strip(" \t")))
    return pairs, {k.lower(): v for k, v in pairs}


def _head(src) -> bytes | None:
    """The header block of the next record of any version, which is read up to its end; None at the end of what can be read."""
    while True:
        start = src.peek(10)
        if not start:
            return None
        if not _MARK.match(start):
            line = src.peek(_HEAD)
            at = _MARK.search(line, 1)
            src.skip(at.start() if at else max(1, len(line) - 6))
            continue
        size = _HEAD
        while size <= _LONGEST_HEAD:
            text = src.peek(size)
            ends = [k + n for k, n in ((text.find(b"\r\n\r\n"), 4), (text.find(b"\n\n"), 2)) if k >= 0]
            if ends:
                return src.read(min(ends))
            if len(text) < size:
                return src.read(len(text))
            size *= 2
        src.skip(6)  # no header ends so late


def _records(src, wanted: dict[str, set], names: list[str], first: int = 0, end: int | None = None, file: str = "") -> Iterator[dict]:
    """Rows of the records in a range of a file, as far as the wanted names need them; with `damage` among them, damaged members too."""
    raw = _Bytes(src, first, src.size() if end is None else end)
    stream: _Bytes | _Inflated | None = None  # from the first member without skip lengths on
    while True:
        size = _skip_lengths(raw.peek(24)) if stream is None else None
        if size:
            one = _Inflated(raw.part(size))
        else:
            one = stream = stream or (_Inflated(raw) if raw.peek(2) == b"\x1f\x8b" else raw)
        text = _head(one)
        hurt = isinstance(one, _Inflated) and one.stopped
        if text is None and not size and not hurt:
            return
        row, rest = _row(one, text, wanted, names) if text is not None else (None, 0)
        if row is not None:
            yield row
        if size:
            raw.skip(size)
        elif rest:
            one.skip(rest)
        if isinstance(one, _Inflated) and one.stopped and (size or not one.ready):
            bad = one.resume()
            if "damage" in names and not wanted:
                yield from ({k: f"{file}@{at}" if k == "damage" else None for k in names} for at in bad)


def _row(src, text: bytes, wanted: dict[str, set], names: list[str]) -> tuple[dict | None, int]:
    """The row of a record whose headers have been read, or None, and the bytes of its block still to skip."""
    pairs, head = _headers(text.decode("utf-8", "replace"))
    try:
        length = max(0, int(head["content-length"]))
    except (KeyError, ValueError):
        return None, 0
    plain = lambda k: _plain(head[k]) if k in head else None
    row = {"record_type": plain("warc-type"), "record_id": plain("warc-record-id"), "target_uri": plain("warc-target-uri")}
    if any(row[k] not in v for k, v in wanted.items()):
        return None, length
    row["refers_to"] = plain("warc-refers-to")
    row["payload_digest"] = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
    given = head.get("warc-payload-length", "")
    row["payload_bytes"] = int(given) if given.isdigit() else None
    row["headers"] = pairs
    needed = bool({"payload", "stored_bytes", "stored_sha256"} & set(names)) or "payload_bytes" in names and row["payload_bytes"] is None
    if needed and row["record_type"] != "revisit":
        block = src.read(length)
        if len(block) < length and isinstance(src, _Inflated) and src.stopped:
            return None, 0  # the rest of the record is damaged
        length = 0
        http = head.get("content-type", "").lower().startswith("application/http")
        at = block.find(b"\r\n\r\n") if http else -1
        payload = block[at + 4 :] if at >= 0 else block
        row["stored_bytes"] = len(payload)
        if row["payload_bytes"] is None:
            row["payload_bytes"] = len(payload)
        if "stored_sha256" in names:
            row["stored_sha256"] = hashlib.sha256(payload).hexdigest()
        if "payload" in names:
            row["payload"] = payload
    return {k: row.get(k) for k in names}, length


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("splitBytes", 32 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("level", 1)))


def write_warc(records: DataFrame, path: str, level: int = 1) -> None:
    """Write rows with the columns of WRITE_SCHEMA as archives below a new folder."""
    records.sparkSession.dataSource.register(WarcSource)
    records.select(*(x.split()[0] for x in WRITE_SCHEMA.split(", "))).write.format("warc").option("level", level).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, columns: str = READ_SCHEMA, split_bytes: int = 32 << 20) -> DataFrame:
    """Read archives; `columns` is the part of READ_SCHEMA that is needed.

    Turns on the session's pushdown to Python data sources, which the reader's predicates need.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(columns).option("splitBytes", split_bytes).load(path)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """One record per page; of equal payloads of `least` bytes or more only the smallest id keeps its.

    The others are revisits that refer to it.  A null html is an empty payload.  A row with a
    null id is a response of its own.  Rows that repeat the smallest id are all responses.
    Payloads move through one shuffle on id and digest, which no group of copies makes uneven.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    keys = rows.where(F.col("payload_bytes") >= least).select("id", "payload_digest")
    first = keys.groupBy("payload_digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = keys.join(dealt_anew(first.select("payload_digest", "first"), "payload_digest"), "payload_digest").where("id != first").distinct()
    out = rows.join(again, ["id", "payload_digest"], "left")
    revisit = F.col("first").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    return out.select(
        urn("id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", urn("first").alias("refers_to"),
        "payload_digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as archives (below the shared folder if no path is given) and read them back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri; length
    and digest of a response are measured on the payload read back.
    """
    spark = pages.sparkSession
    tk.bound_batches(spark)
    path = path or Scratch(spark).path("warc")
    write_warc(page_records(pages), path)
    got = read_warc(spark, path, "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, stored_bytes long, stored_sha256 string")
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return got.select(
        number("record_id").alias("page_id"), F.coalesce("stored_bytes", "payload_bytes").alias("payload_bytes"),
        F.coalesce("stored_sha256", "payload_digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), "target_uri",
    )
