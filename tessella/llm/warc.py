"""WARC archives: a writer with one gzip member per record, and a sequential reader.

Writer: equal payloads are found by SHA-256 (natively, before any payload moves); of a group
the record with the largest page id is a ``response``, the others are ``revisit`` records that
refer to it and carry the HTTP headers only. Each task writes its rows into archives below the
shared folder. Names follow from partition and place, so a task that is run again writes the
same files, and readers go by the manifest.

Reader: members are decompressed incrementally, never further than what is asked for, so a member
that unpacks to more than its record states costs no memory. Records are framed by Content-Length,
and digests are verified as the bytes pass by; any mismatch is an error. Any record of WARC/1.0
and 1.1 is read, whatever its type and id; digests that a record doesn't state, or states in an
algorithm that ``hashlib`` lacks, aren't verified. Archives are read side by side, a few per task.

Defined cases: a null payload counts as empty; a null url leaves out the target header; a null
page id is written as ``null`` and ranks below all others; ids that this writer didn't make give
a null page id; rows that repeat the response's id and payload are responses too; payloads may be
as long as a row can be (a writer holds one archive, a reader that wants no payloads one buffer);
an empty table gives no archive and no record; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import TASK_BATCHES, filesystem, lookup, new_folder, write_atomically, written

DATE = "1970-01-01T00:00:00Z"
CHUNK = 1 << 16
#: Bytes of payload after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Longest headers that a reader looks for the end of.
HEADER_BYTES = 1 << 20
#: Archives that a task reads where there are more than two per core.
TASK_ARCHIVES = 4


def digest32(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    """The page id in a record id of this writer, null for any other."""
    name = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(name) if name.removeprefix("-").isdecimal() else None


def _header_value(text: str) -> str:
    """A header value on one line: control characters percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text)


def encode_record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_header_value(url)}"] if url is not None else []),
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        *(
            [
                "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                f"WARC-Refers-To: {_urn(refers_to)}",
            ]
            if revisit
            else []
        ),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


class _Source:
    """A compressed stream and the place in it."""

    def __init__(self, stream: BinaryIO, chunk: int) -> None:
        self.stream, self.chunk, self.data, self.at = stream, chunk, b"", 0

    def filled(self) -> bool:
        self.data = self.data or self.stream.read(self.chunk)
        return bool(self.data)


class Member:
    """One gzip member, decompressed as far as it is read."""

    def __init__(self, source: _Source) -> None:
        self.source, self.begun = source, source.at
        self.press, self.held = zlib.decompressobj(31), b""

    def read(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the member's end."""
        out, self.held = [self.held[:n]], self.held[n:]
        n -= len(out[0])
        while n > 0 and not self.press.eof:
            if not self.source.filled():
                raise ValueError(f"the gzip member at {self.begun} is cut off")
            out.append(self.press.decompress(self.source.data, n))
            rest = self.press.unused_data if self.press.eof else self.press.unconsumed_tail
            self.source.at += len(self.source.data) - len(rest)
            self.source.data = rest
            n -= len(out[-1])
        return b"".join(out)

    def headers(self, most: int) -> bytes | None:
        """What stands before the next empty line, if that comes within ``most`` bytes; what follows is read next."""
        seen = b""
        while (end := seen.find(b"\r\n\r\n")) < 0 and len(seen) < most:
            if not (more := self.read(min(4096, most - len(seen)))):
                break
            seen += more
        self.held = (seen[end + 4 :] if end >= 0 else seen) + self.held
        return seen[:end] if end >= 0 else None


def members(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[Member]:
    """The gzip members of a stream, one after another; each has to be read to its end."""
    source = _Source(stream, chunk)
    while source.filled():
        yield (member := Member(source))
        if not member.press.eof and (member.read(1) or not member.press.eof):
            raise ValueError(f"the gzip member at {member.begun} goes on after its record")


def read_members(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """Offset and whole contents of each gzip member."""
    for member in members(stream, chunk):
        parts = []
        while part := member.read(CHUNK):
            parts.append(part)
        yield member.begun, b"".join(parts)


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before."""
    found: dict[str, str] = {}
    name = ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            found[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


class _Digest:
    """A stated digest, ``algorithm:value`` in base 32 or 16, and the bytes that should have it."""

    def __init__(self, stated: str | None) -> None:
        name, _, self.value = (stated or "").partition(":")
        name = name.lower().replace("-", "")
        self.known = bool(self.value) and name in hashlib.algorithms_available and not name.startswith("shake")
        self.hash = hashlib.new(name) if self.known else None

    def update(self, data: bytes) -> None:
        if self.known:
            self.hash.update(data)

    def wrong(self) -> bool:
        if not self.known:
            return False
        raw = self.hash.digest()
        own = base64.b32encode(raw).decode().rstrip("="), binascii.hexlify(raw).decode().upper()
        return self.value.upper().rstrip("=") not in own


def read_record(member: Member, payloads: bool = False) -> dict:
    """Fields of a record; framing and digests are verified. The payload is kept only if asked for."""
    head = member.headers(HEADER_BYTES)
    lines = (head or b"").split(b"\r\n")
    if head is None or not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record at {member.begun}")
    fields = _fields(lines[1:])
    name, kind = fields.get("warc-record-id"), fields.get("warc-type")
    if not fields.get("content-length", "").isdecimal():
        raise ValueError(f"{name}: no Content-Length")
    left = int(fields["content-length"])
    block, payload = _Digest(fields.get("warc-block-digest")), _Digest(fields.get("warc-payload-digest"))
    sha, size, kept = hashlib.sha1(), 0, []
    body: bool | None = not fields.get("content-type", "").lower().startswith("application/http")
    front, http = b"", {}
    while left:
        part = member.read(min(CHUNK, left))
        if not part:
            raise ValueError(f"{name}: Content-Length does not frame the block")
        left -= len(part)
        block.update(part)
        if not body:  # HTTP headers come first
            front += part
            end = front.find(b"\r\n\r\n")
            if end < 0 and left and len(front) < HEADER_BYTES:
                continue
            http = _fields(front[: end if end >= 0 else len(front)].split(b"\r\n")[1:])
            body, part = True, front[end + 4 :] if end >= 0 else b""
        sha.update(part)
        payload.update(part)
        size += len(part)
        if payloads:
            kept.append(part)
    if member.read(5) != b"\r\n\r\n":
        raise ValueError(f"{name}: Content-Length does not frame the block")
    if block.wrong():
        raise ValueError(f"{name}: wrong block digest")
    whole = kind != "revisit" and fields.get("warc-segment-number") is None
    # a digest of a chunked body may be of what the chunks hold
    if whole and payload.wrong() and "chunked" not in http.get("transfer-encoding", "").lower():
        raise ValueError(f"{name}: wrong payload digest")
    stated = fields.get("warc-payload-digest", "")
    if kind == "revisit" and http.get("content-length", "").isdecimal():
        size = int(http["content-length"])  # of the payload that it refers to
    own = stated.removeprefix("sha1:") if stated.startswith("sha1:") else base64.b32encode(sha.digest()).decode() if whole else None
    return {
        "page_id": _page(name),
        "payload_bytes": size,
        "payload_digest": own,
        "record_type": kind,
        "refers_to": _page(fields.get("warc-refers-to")),
        "record_id": name,
        "url": fields.get("warc-target-uri"),
        "payload": b"".join(kept) if payloads and kind != "revisit" else None,
    }


RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("record_id", pa.string()),
        ("url", pa.string()),
        ("archive", pa.string()),
        ("offset", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def read_archive(stream: BinaryIO, name: str, payloads: bool = False) -> Iterator[dict]:
    """Records of an archive, as rows of ``RECORD``."""
    for member in members(stream):
        yield read_record(member, payloads) | {"archive": name, "offset": member.begun}


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write the archives; their manifest (archive, records), read back from the shared folder."""
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.sha2("payload", 256))
    keys = written(base.select("page_id", "sha", F.length("payload").alias("n_bytes")).distinct(), "warc-keys")
    groups = keys.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("owner"))
    plan = lookup(keys, groups, ["sha"], "n", F.col("page_id"))
    again = (F.col("n_bytes") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    plan = plan.select(
        F.col("page_id").alias("plan_id"),
        F.col("sha").alias("plan_sha"),
        again.alias("revisit"),
        F.when(again, F.col("owner")).alias("refers_to"),
    )
    # the id goes first among the join keys' parts: pages spread evenly whatever their payloads
    match = base["page_id"].eqNullSafe(plan["plan_id"]) & (base["sha"] == plan["plan_sha"])
    rows = base.join(plan, match).select("page_id", "url", "payload", "revisit", "refers_to")

    def run(parts):
        first = TaskContext.get().partitionId() * TASK_BATCHES
        buffer, held, records, done = io.BytesIO(), 0, 0, 0

        def close():
            nonlocal buffer, held, records, done
            number = first + done
            uri = f"{folder}/{number // TASK_BATCHES % 1000:03d}/{number}.warc.gz"
            write_atomically(uri, lambda out: out.write(buffer.getbuffer()))
            row = pa.record_batch({"archive": [uri], "records": pa.array([records], pa.int64())})
            buffer, held, records, done = io.BytesIO(), 0, 0, done + 1
            return row

        for part in parts:
            for page_id, url, payload, revisit, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                buffer.write(encode_record(page_id, url, payload, refers_to, revisit))
                held += len(payload)
                records += 1
                if held >= archive_bytes:
                    yield close()
        if records:
            yield close()

    return written(rows.mapInArrow(run, "archive string, records long"), "warc-manifest")


def read_warc(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of the archives that the manifest names, an archive at a time in each task."""

    def run(parts):
        for part in parts:
            for uri in part.column("archive").to_pylist():
                files, path = filesystem(uri)
                with files.open_input_stream(path, compression=None) as stream:
                    rows = []
                    held = 0
                    for row in read_archive(stream, uri.rpartition("/")[2], payloads):
                        rows.append(row)
                        held += len(row["payload"] or b"")
                        if len(rows) == 256 or held > ARCHIVE_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, RECORD)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)

    archives, cores = manifest.count(), manifest.sparkSession.sparkContext.defaultParallelism
    # a stated number of partitions, which adaptive execution leaves as it is
    tasks = max(1, min(archives, 2 * cores), -(-archives // TASK_ARCHIVES))
    return manifest.repartition(tasks).mapInArrow(
        run,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "record_id string, url string, archive string, offset long, payload binary",
    )


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write a record per page, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    manifest = write_warc(pages, new_folder(pages.sparkSession, "warc"), **columns)
    return read_warc(manifest).drop("payload", "url", "record_id")
