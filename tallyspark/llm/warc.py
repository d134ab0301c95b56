"""WARC archives, and a reader that salvages what damage has left (operator 8).

*Writing.*  Each record is a gzip member of its own.  Of records with equal
payloads of at least ``LEAST`` bytes the one with the largest id is a ``response``,
the others are ``revisit`` records without payload that refer to it.  A task
starts a new file after ``ROLL`` bytes, under a name that no other attempt uses,
and returns the names; only files of attempts that succeeded are ever read.

*Reading.*  A file is read piece by piece, one record in memory at a time; members
and bare records may follow each other.  A record counts if its member's CRC,
its version line, its length, the blank lines after it and its payload's digest
are right.  Otherwise the reader searches, from the next byte on, for the first
place at which a member or version line begins a record that passes, and logs the
bytes between as a gap with the reason.

Files are opened through ``pyarrow.fs`` by their URI, in the tasks, so the folder
may be on any file system it knows; the driver lists nothing.

A null payload is empty, a null URL is left out, a null id is written as none and
read as null.  Of equal rows with the largest id all are responses.  Extra columns
are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import shared_folder, written

LEAST, ROLL = 1000, 32 << 20
_PIECE, _HEADER = 1 << 18, 1 << 16
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_VERSION = re.compile(rb"WARC/1\.[0-9]\r\n")
_BEGIN = re.compile(rb"\x1f\x8b\x08|" + _VERSION.pattern)


class Damaged(Exception):
    """What stands here isn't a whole record."""


def record(page: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None,
           date: str = "2000-01-01T00:00:00Z") -> bytes:
    """A record as it stands in the file; without payload a revisit."""
    block = _HTTP + (payload if payload is not None else b"")
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if payload is not None else b"revisit"),
            f"WARC-Record-ID: <urn:x-page:{'none' if page is None else page}>".encode(), f"WARC-Date: {date}".encode(),
            b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)), f"X-Payload-Length: {size}".encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~").encode())
    if payload is None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>".encode()]
    head += [b"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}".encode(), b"", b""]
    return b"\r\n".join(head) + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """(file, records, bytes) of the archives written below ``folder`` from
    (page_id, url, payload binary, digest, size, refers_to); a payload is null for revisits."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name, out, count, size, done = "", None, 0, 0, []
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, count, size = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(record(*[x.as_py() for x in row])) + packer.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= roll:
                    out.close()
                    done.append({"file": f"{folder.rstrip('/')}/{name}", "records": count, "bytes": size})
                    out = None
        if out is not None:
            out.close()
            done.append({"file": f"{folder.rstrip('/')}/{name}", "records": count, "bytes": size})
        yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return pages.select("page_id", "url", "payload", "digest", "size", "refers_to").mapInArrow(archive, "file string, records long, bytes long")


class Source:
    """Bytes of an open file by place, with the piece read last at hand."""

    def __init__(self, file) -> None:
        self.file, self.size, self.at, self.piece = file, file.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.piece)):
            self.file.seek(at)
            self.at, self.piece = at, self.file.read(max(n, _PIECE))
        return self.piece[at - self.at : at - self.at + n]


def _parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[0-9]", lines[0]):
        raise Damaged("no version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("a header line has no colon")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        raise Damaged("no length")
    return fields


def _checked(fields: dict[str, str], block: bytes) -> dict:
    kind = fields.get("warc-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if "http" in fields.get("content-type", "") else block
    said = fields.get("warc-payload-digest", "")
    sha1 = said[5:] if said.startswith("sha1:") else ""
    digest = hashlib.sha1(payload).hexdigest()
    if kind == "revisit":
        digest = base64.b32decode(sha1).hex() if sha1 else None
    elif sha1 and base64.b32decode(sha1).hex() != digest:
        raise Damaged("the payload has another digest")
    page = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?[0-9]+)>", fields.get(name, ""))) else None
    size = len(payload) if kind != "revisit" else int(fields["x-payload-length"]) if fields.get("x-payload-length", "").isdigit() else None
    return {"type": kind, "page_id": page("warc-record-id"), "refers_to": page("warc-refers-to"), "uri": fields.get("warc-target-uri"),
            "digest": digest, "size": size, "payload": payload}


def _member(source: Source, at: int) -> tuple[list[dict], int]:
    """The records of one member.  Its first must be whole; behind it, a record that is not
    becomes a gap of the member's bytes, and reading goes on at the next version line."""
    packed, data, place = zlib.decompressobj(31), [], at
    while not packed.eof:
        piece = source.read(place, min(_PIECE, source.size - place))
        if not piece:
            raise Damaged("the member ends early")
        try:
            data.append(packed.decompress(piece))
        except zlib.error as problem:
            raise Damaged(f"the member is broken: {problem}") from None
        place += len(piece)
    whole, end = b"".join(data), place - len(packed.unused_data)
    record, start = _within(whole, 0)
    out = [{"kind": "record", "reason": None} | record]
    while start < len(whole):
        try:
            record, after = _within(whole, start)
        except (Damaged, ValueError) as problem:
            following = _VERSION.search(whole, start + 1)
            after = following.start() if following else len(whole)
            out.append({"kind": "gap", "reason": f"bytes {start} to {after} of the member: {problem}"})
        else:
            out.append({"kind": "record", "reason": None} | record)
        start = after
    return out, end


def _within(whole: bytes, start: int) -> tuple[dict, int]:
    blank = whole.find(b"\r\n\r\n", start)
    if blank < 0:
        raise Damaged("the header doesn't end")
    fields = _parsed(whole[start:blank])
    end = blank + 4 + int(fields["content-length"])
    if whole[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the length is wrong")
    return _checked(fields, whole[blank + 4 : end]), end + 4


def _bare(source: Source, at: int) -> tuple[list[dict], int]:
    width, blank = _HEADER, b""
    while not blank:
        head, blank, _ = source.read(at, min(width, source.size - at)).partition(b"\r\n\r\n")
        if not blank and at + width >= source.size:
            raise Damaged("the header doesn't end")
        width *= 2
    fields = _parsed(head)
    start = at + len(head) + 4
    end = start + int(fields["content-length"])
    if end + 4 > source.size or source.read(end, 4) != b"\r\n\r\n":
        raise Damaged("the length is wrong")
    return [{"kind": "record", "reason": None} | _checked(fields, source.read(start, end - start))], end + 4


def salvage(source: Source) -> Iterator[dict]:
    """Records, and gaps between those that pass, in the order of the file."""
    at, bad, reason = 0, None, None
    while at < source.size:
        try:
            first = source.read(at, min(3, source.size - at))
            found, end = _member(source, at) if first == b"\x1f\x8b\x08" else _bare(source, at)
        except (Damaged, ValueError) as problem:
            if bad is None:
                bad, reason = at, str(problem)
            at = _next(source, at + 1)
            continue
        if bad is not None:
            yield {"kind": "gap", "at": bad, "length": at - bad, "reason": reason}
            bad = None
        yield from ({"at": at, "length": end - at} | x for x in found)
        at = end
    if bad is not None:
        yield {"kind": "gap", "at": bad, "length": source.size - bad, "reason": reason}


def _next(source: Source, at: int) -> int:
    """Where a member or version line may begin, at or after ``at``; else the end."""
    while at < source.size:
        piece = source.read(at, min(_PIECE, source.size - at))
        if m := _BEGIN.search(piece):
            return at + m.start()
        at += max(1, len(piece) - 16) if at + len(piece) < source.size else len(piece)
    return source.size


_READ = ("file string, kind string, at long, length long, reason string, type string, page_id long, refers_to long, uri string, "
         "digest string, size long, payload binary")
_READ_TYPE = pa.schema([("file", pa.string()), ("kind", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("reason", pa.string()),
                        ("type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("uri", pa.string()), ("digest", pa.string()),
                        ("size", pa.int64()), ("payload", pa.binary())])


def read(files: DataFrame, payloads: bool = True) -> DataFrame:
    """All records and gaps of the archives named in column ``file``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(name)
                out, held = [], 0
                with system.open_input_file(path) as file:
                    for x in salvage(Source(file)):
                        out.append({"file": name} | x | ({} if payloads else {"payload": None}))
                        held += len(out[-1].get("payload") or b"") + 100
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, _READ_TYPE)
                            out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, _READ_TYPE)

    # a task for each file, or for up to 16 where there are more than tasks by default
    n = files.count()
    tasks = max(1, -(-n // 16), min(n, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return files.select("file").repartition(tasks).mapInArrow(rows, _READ)


def archived(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html",
             roll: int = ROLL) -> DataFrame:
    """Write every page of ``pages`` to archives; the result names the files."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload")).withColumns(
        {"digest": F.sha1("payload")}).withColumn("size", F.octet_length("payload").cast("long"))
    # of payloads that occur more than once: where they are kept
    kept = pages.select(F.col(key).cast("long").alias("p"), F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("b")).select(
        "p", F.sha1("b").alias("digest"), F.octet_length("b").cast("long").alias("size")).where(F.col("size") >= LEAST)
    kept = kept.groupBy("digest", "size").agg(F.max("p").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    placed = rows.join(kept, ["digest", "size"], "left").withColumn(
        "refers_to", F.when(F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id")), F.col("kept")))
    placed = placed.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    return written(write(placed, folder or shared_folder(pages.sparkSession), roll))
