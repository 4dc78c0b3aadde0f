"""WARC archives: a writer with revisit records and a reader that splits files.

Archives are gzip files with one member per record.  The reader's tasks scan byte ranges: a task looks for the
gzip magic from the start of its range, validates a candidate by inflating its first bytes, which must be
the header of a WARC record, and from then on goes from member to member.  It owns the records that start
inside its range and reads past the end to finish the last one; what starts before belongs to the task before.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the public WARC 1.1 and gzip formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

REVISIT_FROM = 1000
FILE_BYTES = 128 << 20
RANGE_BYTES = 16 << 20
READ_BYTES = 1 << 20
MOST_TASKS = 20_000
LEVEL = 5
MANIFEST = "path string, bytes long, records long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, not compressed.  A revisit keeps the HTTP header, whose length tells the payload's, and no payload."""
    revisit = refers_to is not None
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {target}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return VERSION + "\r\n".join(head).encode() + END + block + END


def classified(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to) per row of ``pages``: who repeats whom.

    Of payloads of at least ``REVISIT_FROM`` bytes that are equal the largest id is the response.  Smaller
    payloads join on a key of their own, so neither they nor nulls gather anywhere.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_FROM
    first = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1")
    own = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("small "), F.hex(F.xxhash64("page_id", "digest"))))
    joined = rows.withColumn("same", own).join(first.select(F.col("digest").alias("same"), "best"), "same", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("best")), F.col("best"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``classified`` pages below ``folder``; gives the manifest (path, bytes, records), lazily.

    Every attempt of a task writes files with names of its own, so one that is repeated or lost leaves
    files that no manifest names; cut the manifest with a written table before reading the archives.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _open(folder)
        system.create_dir(top, recursive=True)
        out = name = None
        size = records = 0
        done = []

        def close() -> None:
            out.close()
            done.append((f"{folder}/{name}", size, records))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, records = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{top}/{name}", compression=None)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = packer.compress(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], date)) + packer.flush()
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        columns = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_pydict({"path": pa.array(columns[0], pa.string()), "bytes": pa.array(columns[1], pa.int64()), "records": pa.array(columns[2], pa.int64())})

    return pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, MANIFEST)


class _Window:
    """Sequential reads of one file from an offset; bytes not needed any more are let go."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data, self.over = file, start, b"", False
        file.seek(start)

    def more(self) -> bool:
        chunk = b"" if self.over else self.file.read(READ_BYTES)
        self.over = not chunk
        self.data += chunk
        return bool(chunk)

    def drop_to(self, offset: int) -> None:
        self.data, self.start = self.data[offset - self.start :], offset


def _is_record(window: _Window, offset: int) -> bool:
    """Whether the member at ``offset`` inflates to the beginning of a record."""
    unpack, at, found = zlib.decompressobj(31), offset - window.start, b""
    while True:
        try:
            found += unpack.decompress(window.data[at : at + 4096], 64)
        except zlib.error:
            return False
        if len(found) >= 5 or unpack.eof:
            return found.startswith(b"WARC/")
        at += 4096
        if at >= len(window.data) and not window.more():
            return False


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated record) of the members of an open file that start in [start, end)."""
    window, offset, synced = _Window(file, start), start, False
    while offset < end:
        if not synced:
            at = window.data.find(MAGIC, offset - window.start)
            if at < 0:
                offset = max(offset, window.start + len(window.data) - len(MAGIC) + 1)
                window.drop_to(min(offset, window.start + len(window.data)))
                if not window.more():
                    return
                continue
            offset = window.start + at
            if offset >= end:
                return
            if not _is_record(window, offset):
                offset += 1
                continue
            synced = True
        window.drop_to(offset)
        unpack, parts, at = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if at >= len(window.data):
                window.drop_to(window.start + at)
                at = 0
                if not window.more():
                    if not parts and not window.data:
                        return
                    raise ValueError(f"the member at byte {offset} is cut short")
            fed = window.data[at:]
            parts.append(unpack.decompress(fed))
            at += len(fed) - len(unpack.unused_data)
        yield offset, b"".join(parts)
        offset = window.start + at


def _headers(data: bytes) -> dict[str, str]:
    fields = (line.partition(":") for line in data.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in fields}


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def parse(data: bytes) -> dict:
    """The fields of one record.  Length and digest of a response are those of the payload read, of a revisit as its headers tell."""
    head, _, rest = data.partition(END)
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(END)
    revisit = fields["warc-type"] == "revisit"
    algorithm, _, stated = fields.get("warc-payload-digest", "").partition(":")
    stated = base64.b32decode(stated).hex() if algorithm == "sha1" else None
    digest = stated if revisit else hashlib.sha1(payload).hexdigest()
    return {
        "page_id": _page(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload_bytes": int(_headers(http).get("content-length", 0)) if revisit else len(payload),
        "payload_digest": digest,
        "sound": revisit or stated in (None, digest),
        "payload": None if revisit else payload,
    }


RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("sound", pa.bool_()),
        ("payload", pa.binary()),
    ]
)


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """One row per record of the files in ``manifest`` (path, bytes): page_id, url (percent-encoded as stored),
    record_type, refers_to, payload_bytes, payload_digest, sound (the payload has the digest its header states)
    and payload (null for revisits, and for all if not ``payloads``).

    Files are read in byte ranges, each a task's work wherever it starts.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = manifest.where("bytes > 0").select("path", F.explode(starts).alias("start"))
    # A range is one small row and much work, so the number of tasks is set; by size they would be put together.
    ranges = ranges.repartition(max(1, min(ranges.count(), MOST_TASKS)), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _open(row["path"])
                rows, size = [], 0
                with system.open_input_file(path) as file:
                    for _, data in members(file, row["start"], row["start"] + range_bytes):
                        found = parse(data)
                        if not payloads:
                            found["payload"] = None
                        rows.append(found)
                        size += len(found["payload"] or b"") + 500
                        if size > READ_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, RECORD)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORD)

    return ranges.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, sound boolean, payload binary")
