"""WARC files: one gzip member per record, read sequentially and verified."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Compressed bytes after which the writer starts another file; bytes that the reader takes at a time.
FILE_BYTES, READ_BYTES = 256 << 20, 1 << 18
LEVEL = 4
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

RECORD = (
    "path string, offset long, length long, status string, type string, record_id string, target_uri string, date string, "
    "content_type string, content_length long, fields map<string,string>, http_status int, payload binary, verified boolean"
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(payload: bytes, uri: str | None, date: str, fields: dict[str, str] | None = None) -> bytes:
    """A response record of one HTTP message, as one gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    name = uuid.uuid5(_NAMESPACE, f"{uri}\n{sorted((fields or {}).items())}\n{digest(block)}")
    head = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date)]
    if uri is not None:
        head.append(("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A")))
    head += sorted((fields or {}).items())
    head += [
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", digest(block)),
        ("WARC-Payload-Digest", digest(payload)),
        ("Content-Length", str(len(block))),
    ]
    raw = b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class Reader:
    """Records of a stream, in order.

    The compressed bytes are inflated piece by piece; a record's head ends at the
    first empty line, its block is framed by Content-Length and must be followed by
    two line ends and the end of the gzip member.  Each record is a dict whose
    ``status`` is ok, bad_digest, bad_length, bad_head, bad_gzip or truncated.
    After a damaged member reading goes on at the next one.
    """

    def __init__(self, stream: BinaryIO, read_bytes: int = READ_BYTES):
        self.stream, self.read_bytes = stream, read_bytes
        self.buffer, self.at = b"", 0

    def _more(self) -> bool:
        piece = self.stream.read(self.read_bytes)
        self.buffer += piece
        return bool(piece)

    def __iter__(self) -> Iterator[dict]:
        while self.buffer or self._more():
            start = self.at
            status, data = self._member()
            yield {"offset": start, "length": self.at - start} | parse(data, status)

    def _member(self) -> tuple[str, bytes]:
        inflate = zlib.decompressobj(31)
        parts: list[bytes] = []
        taken = 0
        try:
            while not inflate.eof:
                if not self.buffer and not self._more():
                    return "truncated", b"".join(parts)
                piece, self.buffer = self.buffer, b""
                taken += len(piece)
                parts.append(inflate.decompress(piece))
            self.buffer = inflate.unused_data
            self.at += taken - len(self.buffer)
            return "ok", b"".join(parts)
        except zlib.error:
            self.buffer = piece
            self.at += taken - len(piece)
            self._resync(skip=1 if taken == len(piece) else 0)
            return "bad_gzip", b"".join(parts)
        finally:
            if not inflate.eof and not self.buffer:
                self.at += taken

    def _resync(self, skip: int) -> None:
        """To the next bytes that begin a gzip member."""
        while True:
            found = self.buffer.find(b"\x1f\x8b\x08", skip)
            if found >= 0:
                self.at += found
                self.buffer = self.buffer[found:]
                return
            keep = min(2, max(0, len(self.buffer) - skip))
            self.at += len(self.buffer) - keep
            self.buffer, skip = self.buffer[len(self.buffer) - keep :], 0
            if not self._more():
                self.at += len(self.buffer)
                self.buffer = b""
                return


def parse(data: bytes, status: str = "ok") -> dict:
    """The record of one inflated member."""
    out: dict = dict.fromkeys(("type", "record_id", "target_uri", "date", "content_type", "content_length", "http_status", "payload"))
    out |= {"fields": {}, "verified": False, "status": status}
    until = data.find(b"\r\n\r\n")
    head, gap = data[: max(until, 0)], until >= 0
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        return out | {"status": status if status != "ok" else "bad_head"}
    name = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:  # a folded line
            out["fields"][name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        out["fields"][name] = value.strip()
    f = out["fields"]
    out |= {"type": f.get("warc-type"), "record_id": f.get("warc-record-id"), "target_uri": f.get("warc-target-uri"), "date": f.get("warc-date"), "content_type": f.get("content-type")}
    size = f.get("content-length", "")
    if not size.isdigit():
        return out | {"status": status if status != "ok" else "bad_head"}
    out["content_length"] = int(size)
    begin = len(head) + 4
    block, tail = data[begin : begin + int(size)], data[begin + int(size) :]
    payload = block
    if (out["content_type"] or "").startswith("application/http"):
        message, gap, payload = block.partition(b"\r\n\r\n")
        first = message.split(b"\r\n", 1)[0].split(b" ")
        if len(first) > 1 and first[1].isdigit():
            out["http_status"] = int(first[1])
    out["payload"] = payload
    if status != "ok":
        return out
    if len(block) < int(size) or tail != b"\r\n\r\n":
        return out | {"status": "bad_length"}
    given = [(f["warc-block-digest"], block)] if "warc-block-digest" in f else []
    given += [(f["warc-payload-digest"], payload)] if "warc-payload-digest" in f else []
    if any(d.lower().startswith("sha1:") and d.upper() != digest(b).upper() for d, b in given):
        return out | {"status": "bad_digest"}
    return out | {"verified": bool(given)}


def write(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) as WARC files in the shared folder; (path, records) of each file.

    Every task writes files of its own under names that are never used again, and
    only files of tasks that ended well are listed, so a retried task leaves no
    double records.  Rows with a null html have no record; a null url or page_id
    leaves out that field.
    """
    folder = shared.new_path(pages.sparkSession, "warc")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, listed, size, count = None, [], 0, 0
        for frame in frames:
            for page_id, url, html in zip(frame["page_id"].tolist(), frame["url"].tolist(), frame["html"].tolist()):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                raw = record(html.encode("utf-8", "surrogatepass"), url, date, {} if page_id is None else {"X-Page-Id": page_id})
                out.write(raw)
                size, count = size + len(raw), count + 1
                if size >= file_bytes:
                    out.close()
                    listed.append((f"{folder}/{name}", count))
                    out = None
        if out is not None:
            out.close()
            listed.append((f"{folder}/{name}", count))
        if listed:
            yield pd.DataFrame(listed, columns=["path", "records"])

    rows = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), "url", "html").filter("html IS NOT NULL")
    return shared.written(rows.mapInPandas(run, "path string, records long"), "warc-files")


def read(files: DataFrame, batch_bytes: int = 16 << 20) -> DataFrame:
    """All records of the files in the column ``path``; one task reads a file from start to end.

    Columns: see RECORD.  A file that holds nothing gives no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in RECORD.replace("map<string,string>", "map").split(",")]
        for frame in frames:
            for path in frame["path"]:
                fs, at = pafs.FileSystem.from_uri(path)
                held, size = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for rec in Reader(stream):
                        held.append({"path": path} | rec)
                        size += len(rec["payload"] or b"") + 1000
                        if size >= batch_bytes:
                            yield pd.DataFrame(held, columns=names)
                            held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=names)

    paths = files.select("path").filter("path IS NOT NULL")
    # a file is a unit of work: spread them evenly, whatever partitions they came in
    return paths.repartition(max(1, min(100_000, paths.count())), "path").mapInPandas(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, n_bytes, status, verified) of the pages, written as WARC and read back."""
    got = read(write(pages))
    return got.select(
        F.element_at("fields", "x-page-id").cast("long").alias("page_id"),
        F.col("target_uri").alias("url"),
        F.decode("payload", "UTF-8").alias("html"),
        F.octet_length("payload").cast("long").alias("n_bytes"),
        "status",
        "verified",
    )
