"""WARC archives: a distributed writer and a sequential, verifying reader.

The writer makes one ``.warc.gz`` archive per task (a new one after
``roll_bytes``), a ``warcinfo`` record first, one gzip member per record, in the
shared folder. File names
carry the task attempt, and only archives of attempts that succeeded reach the
manifest, so a lost executor leaves at most unread files.

The reader streams each archive: zlib decompression in chunks, record headers
parsed line by line, block framing by ``Content-Length``, and SHA-1 digests of
block and payload checked against the headers. A record that breaks a rule
raises :class:`WarcError`.

Payloads are equal if their lengths, SHA-1 and SHA-256 are. Of pages with equal
payloads (from ``revisit_bytes`` bytes on) the one with the
smallest id becomes a ``response``, the others ``revisit`` records that refer to
it and carry no payload; their HTTP header keeps the payload's length.

Edge cases: null html is an empty payload; a null ``page_id`` is always a
response and never referred to; rows that repeat the smallest ``page_id`` with
an equal payload are all responses (a page does not refer to itself) and share
a record id, which names the page; null urls
get ``urn:page:`` target URIs; control characters and blanks in urls are
percent-encoded; payloads of any length are written and read whole; extra
columns are ignored; no pages give no archives.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.llm.common import scratch_dir, stage, text_or_empty

_DATE = "2000-01-01T00:00:00Z"  # pages carry no capture time
_CRLF = b"\r\n"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    """An archive that breaks the format's rules or fails a digest."""


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed."""
    own = f"<urn:page:{'none' if page_id is None else page_id}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else own[1:-1]
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {own}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + 2 * _CRLF + block + 2 * _CRLF


def warcinfo(name: str) -> bytes:
    """The record that an archive begins with."""
    block = b"software: pactlake\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", f"WARC-Date: {_DATE}", f"WARC-Filename: {name}",
            f"WARC-Block-Digest: sha1:{_sha1(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + 2 * _CRLF + block + 2 * _CRLF


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Member:
    """Reads one gzip member of a stream, a chunk at a time."""

    def __init__(self, stream, rest: bytes, chunk: int):
        self._stream, self._chunk, self._raw = stream, chunk, rest
        self._zlib, self._data = zlib.decompressobj(31), b""

    def more(self) -> bool:
        if self._zlib.eof:
            return False
        raw = self._raw or self._stream.read(self._chunk)
        if not raw:
            raise WarcError("archive ends within a record")
        self._data += self._zlib.decompress(raw, 4 * self._chunk)
        self._raw = self._zlib.unconsumed_tail
        return True

    def line(self) -> bytes:
        while (at := self._data.find(_CRLF)) < 0:
            if len(self._data) > 1 << 20 or not self.more():
                raise WarcError("unterminated header line")
        line, self._data = self._data[:at], self._data[at + 2 :]
        return line

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self._data and not self.more():
                raise WarcError("block is shorter than its Content-Length")
            part, self._data = self._data[:n], self._data[n:]
            n -= len(part)
            yield part

    def end(self) -> bytes:
        """Checks the record's closing line breaks; returns what follows the member."""
        while self.more():
            pass
        if self._data != 2 * _CRLF:
            raise WarcError("block is longer than its Content-Length")
        return self._zlib.unused_data


def _headers(source: _Member) -> dict[str, str]:
    found = {}
    while line := source.line():
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise WarcError(f"no header: {line[:80]!r}")
        found[name.strip().lower()] = value.strip()
    return found


def _page(uri: str) -> int | None:
    last = uri.strip("<>").rpartition(":")[2]
    return None if last == "none" else int(last)


def read_archive(stream, chunk: int = 1 << 16) -> Iterator[dict]:
    """The responses and revisits of an archive in order, each record verified; memory is bounded by ``chunk``."""
    rest = b""
    while rest := rest or stream.read(chunk):
        source = _Member(stream, rest, chunk)
        if not source.line().startswith(b"WARC/1."):
            raise WarcError("no WARC version line")
        head = _headers(source)
        left = int(head["content-length"])
        block, payload = hashlib.sha1(), hashlib.sha1()
        http, size = b"", 0
        in_payload = False
        for part in source.take(left):
            block.update(part)
            if not in_payload:
                http += part
                if (at := http.find(2 * _CRLF)) >= 0:
                    http, part, in_payload = http[:at], http[at + 4 :], True
                else:
                    continue
            payload.update(part)
            size += len(part)
        rest = source.end()
        if head.get("warc-block-digest") != "sha1:" + base64.b32encode(block.digest()).decode():
            raise WarcError(f"block digest of {head.get('warc-record-id')}")
        if head["warc-type"] == "warcinfo":
            continue
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        length = int(dict(x.lower().split(b": ", 1) for x in http.split(_CRLF)[1:])[b"content-length"])
        if head["warc-type"] == "response" and (size != length or digest != base64.b32encode(payload.digest()).decode()):
            raise WarcError(f"payload digest of {head.get('warc-record-id')}")
        yield {
            "page_id": _page(head["warc-record-id"]),
            "payload_bytes": length,
            "payload_digest": digest,
            "record_type": head["warc-type"],
            "refers_to": _page(head["warc-refers-to"]) if "warc-refers-to" in head else None,
        }


def revisits(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages whose payload an earlier page has."""
    payload = F.encode(text_or_empty("html"), "UTF-8")
    digest = F.concat_ws(":", F.sha1(payload), F.sha2(payload, 256), F.octet_length(payload))
    keys = stage(pages.select("page_id", digest.alias("digest"), F.octet_length(payload).alias("n")), "warc-digests")
    keys = keys.where((F.col("n") >= revisit_bytes) & F.col("page_id").isNotNull())
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to")
    again = keys.join(first, "digest").where("page_id > refers_to")
    return stage(again.groupBy("page_id", "digest").agg(F.min("refers_to").alias("refers_to")), "warc-revisits")


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 0, roll_bytes: int = 1 << 28) -> DataFrame:
    """Write all pages below ``folder``; returns the manifest ``path, records, bytes``."""
    seen = revisits(pages, revisit_bytes).withColumnRenamed("page_id", "__page").withColumnRenamed("digest", "__digest")
    html = text_or_empty("html")
    payload = F.encode(html, "UTF-8")
    digest = F.concat_ws(":", F.sha1(payload), F.sha2(payload, 256), F.octet_length(payload))
    rows = pages.select("page_id", "url", html.alias("html"), digest.alias("digest"))
    rows = rows.join(seen, (rows["page_id"] == seen["__page"]) & (rows["digest"] == seen["__digest"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, done, count, size = None, [], 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, count, size))
            out = None

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for page_id, url, text, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if out is None or size >= roll_bytes:
                        close()
                        name = f"part-{task.partitionId():05d}-{len(done):04d}-{task.taskAttemptId()}.warc.gz"
                        path, count, size = posixpath.join(root, name), 0, 0
                        out = store.open_output_stream(path, compression=None)
                        out.write(member(warcinfo(name)))
                    data = member(record(page_id, url, text.encode("utf-8", "surrogatepass"), refers_to))
                    out.write(data)
                    count, size = count + 1, size + len(data)
        close()
        paths, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([posixpath.basename(p) for p in paths], pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
            names=["path", "records", "bytes"],
        )

    written = rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long, bytes long")
    return stage(written, "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, archives: int) -> DataFrame:
    """The records of all archives of a manifest; one archive is read by one task, in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        for frame in frames:
            for name, expected in zip(frame["path"], frame["records"], strict=True):
                total = 0
                with store.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    batch = []
                    for found in read_archive(stream):
                        batch.append(found)
                        total += 1
                        if len(batch) == 1000:
                            yield _frame(batch)
                            batch = []
                    yield _frame(batch)
                if total != expected:
                    raise WarcError(f"{name} has {total} records, the manifest {expected}")

    return manifest.select("path", "records").repartition(max(1, archives)).mapInPandas(run, _RECORDS)


def _frame(batch: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(batch, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return frame.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame, revisit_bytes: int = 0, roll_bytes: int = 1 << 28) -> DataFrame:
    """Write archives of all pages and return what the reader finds in them."""
    folder = _uri(scratch_dir(pages.sparkSession, "warc"))
    manifest = write_archives(pages, folder, revisit_bytes, roll_bytes)
    return read_archives(manifest, folder, manifest.count())


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"

