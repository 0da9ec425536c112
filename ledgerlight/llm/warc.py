"""Web archives: write pages as WARC records, and read archives back record by record.

Each record is one gzip member.  The reader is sequential: it inflates a member piece by piece,
takes the header up to the empty line, then exactly Content-Length bytes, then the closing line
ends, and checks the block and payload digests on the way; memory does not grow with a record.  A
member that is cut short, holds more than its record, or does not match a digest raises an error.

Of pages with equal payloads of at least ``least`` bytes the one with the largest id is written
in full; the others are revisits of it, which hold the HTTP header alone.  Rows that repeat the
id of the full one are written in full too.  A null page is an empty payload; null ids come before
all others, and where there is no other the page is written in full.  An empty table writes nothing.

Archives lie in a folder that all executors share, under names of their own for every attempt of
a task; the manifest names those of the attempts that counted.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.common import stored
from ledgerlight.session import shared_folder

#: Compressed bytes from which a task begins another archive, and bytes inflated at a time.
ARCHIVE_BYTES, PIECE = 64 << 20, 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # names that are URLs
_LONGEST_HEADER = 1 << 20


def digest_text(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def _record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page}')}>"


def _line(text: str) -> bytes:
    return text.replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass")


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page)), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest_text(hashlib.sha1(payload).digest())}"),
        ("WARC-Block-Digest", f"sha1:{digest_text(hashlib.sha1(block).digest())}"),
    ]
    if page is not None:
        headers.append(("Page-ID", str(page)))
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    if revisit:
        headers += [
            ("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to)), ("Refers-To-Page-ID", str(refers_to)),
        ]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = b"WARC/1.1\r\n" + b"".join(b"%s: %s\r\n" % (name.encode(), _line(value)) for name, value in headers)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([packer.compress(head + b"\r\n"), packer.compress(block), packer.compress(b"\r\n\r\n"), packer.flush()])


def write_archives(
    pages: DataFrame, folder: str | None = None, least: int = 0, id_column: str = "page_id", url_column: str = "url",
    payload_column: str = "html", archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write the pages and return the manifest: path, records, bytes."""
    folder = folder or shared_folder(pages.sparkSession)
    payload = F.coalesce(F.col(f"`{payload_column}`").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(f"`{id_column}`").cast("long").alias("page"), F.col(f"`{url_column}`").cast("string").alias("url"),
        payload.alias("payload"), F.sha2(payload, 256).alias("content"),
    )
    groups = (
        rows.filter(F.octet_length("payload") >= least).groupBy("content")
        .agg(F.max("page").alias("full"), F.count("content").alias("copies")).filter("copies > 1").drop("copies")
    )
    rows = rows.join(groups, "content", "left").select("page", "url", "payload", "full")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = fs.FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        task = TaskContext.get()
        name = f"{place}/pages-{task.partitionId():06d}-{task.taskAttemptId()}"
        done, out, count = [], None, 0

        def close():
            size = out.tell()
            out.close()
            done.append((f"{name}-{len(done):05d}.warc.gz", count, size))

        for batch in batches:
            for page, url, content, full in zip(*batch.columns):
                if out is None:
                    out, count = system.open_output_stream(f"{name}-{len(done):05d}.warc.gz", compression=None), 0
                page, full = page.as_py(), full.as_py()
                out.write(record(page, url.as_py(), content.as_py(), full, full is not None and full != page))
                count += 1
                if out.tell() >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            paths, counts, sizes = zip(*done)
            root = folder.rstrip("/")
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{root}/{path.rsplit('/', 1)[1]}" for path in paths]), pa.array(counts, pa.int64()),
                 pa.array(sizes, pa.int64())], ["path", "records", "bytes"],
            )

    return stored(rows.mapInArrow(write, "path string, records long, bytes long"))


class Inflater:
    """The bytes of one gzip member after another, a piece at a time."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.member, self.held = stream, b"", None, b""

    def begin(self) -> bool:
        """Go to the next member; False at the end of the archive."""
        if not self.raw:
            self.raw = self.stream.read(PIECE)
        self.member, self.held = zlib.decompressobj(31), b""
        return bool(self.raw)

    def more(self) -> bytes:
        """The next bytes of the member, b"" at its end."""
        while not self.member.eof:
            piece = self.member.decompress(self.raw, PIECE)
            self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if piece:
                return piece
            if not self.member.eof and not self.raw:
                self.raw = self.stream.read(PIECE)
                if not self.raw:
                    raise ValueError("the archive ends inside a record")
        return b""

    def upto(self, mark: bytes, most: int) -> bytes:
        """All bytes through ``mark``."""
        while (at := self.held.find(mark)) < 0:
            piece = self.more()
            if not piece or len(self.held) > most:
                raise ValueError("a header does not end")
            self.held += piece
        found, self.held = self.held[:at + len(mark)], self.held[at + len(mark):]
        return found

    def exactly(self, size: int) -> Iterator[bytes]:
        while size:
            piece = self.held or self.more()
            if not piece:
                raise ValueError("a record is shorter than its Content-Length")
            self.held = piece[size:]
            piece = piece[:size]
            size -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines) if name}


def records(stream, with_payload: bool = False) -> Iterator[dict]:
    """The records of an archive: its fields, payload size and digest, all verified."""
    inflater = Inflater(stream)
    while inflater.begin():
        head = inflater.upto(b"\r\n\r\n", _LONGEST_HEADER)
        if not head.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        fields = _fields(head)
        block, payload, size, kept = hashlib.sha1(), hashlib.sha1(), 0, []
        http, in_payload = b"", False
        for piece in inflater.exactly(int(fields["content-length"])):
            block.update(piece)
            if not in_payload:
                http += piece
                http, mark, piece = http.partition(b"\r\n\r\n")
                if not mark:
                    continue
                in_payload = True
            payload.update(piece)
            size += len(piece)
            if with_payload:
                kept.append(piece)
        if b"".join(inflater.exactly(4)) != b"\r\n\r\n" or inflater.held or inflater.more():
            raise ValueError("a record does not end where its Content-Length says")
        length = int(_fields(b"\r\n".join([b"", *http.split(b"\r\n")]))["content-length"])
        revisit = fields["warc-type"] == "revisit"
        stated = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-block-digest"].removeprefix("sha1:") != digest_text(block.digest()):
            raise ValueError("a block does not match its digest")
        if not revisit and (stated != digest_text(payload.digest()) or size != length):
            raise ValueError("a payload does not match its digest or length")
        yield {
            "fields": fields, "payload_bytes": length, "payload_digest": stated,
            "record_type": fields["warc-type"], "payload": b"".join(kept) if with_payload and not revisit else None,
        }


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the named archives; revisits have no payload of their own."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_stream(place, compression=None) as stream:
                    held, size = [], 0
                    for found in records(stream, with_payload):
                        held.append(found)
                        size += len(found["payload"] or b"")
                        if len(held) >= 10_000 or size > 8 << 20:
                            yield _rows(held)
                            held, size = [], 0
                    if held:
                        yield _rows(held)

    archives = manifest.select("path")
    return archives.repartition(max(1, min(archives.count(), 20_000))).mapInArrow(
        read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, payload binary",
    )


def _rows(found: list[dict]) -> pa.RecordBatch:
    fields = [f["fields"] for f in found]
    def number(name):
        return pa.array([int(f[name]) if name in f else None for f in fields], pa.int64())
    return pa.RecordBatch.from_arrays([
        number("page-id"), pa.array([f.get("warc-target-uri") for f in fields], pa.string()),
        pa.array([f["payload_bytes"] for f in found], pa.int64()),
        pa.array([f["payload_digest"] for f in found], pa.string()),
        pa.array([f["record_type"] for f in found], pa.string()), number("refers-to-page-id"),
        pa.array([f["payload"] for f in found], pa.binary()),
    ], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
