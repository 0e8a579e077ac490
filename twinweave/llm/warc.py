"""WARC archives: a writer that marks repeated payloads, and a splittable reader.

**Writer.** Payloads are compared by SHA-1. Of records with equal payloads of at least ``least_bytes``, that with the largest page id is a
``response``, the others are ``revisit`` records without payload that refer to it. The table of repeated digests is a grouping with
partial aggregates, so a payload that very many pages share costs one row per task. It is written first: its size is known, so Spark
broadcasts it only if it is small and else shuffles. Every record is a gzip member of its own.

**Reader.** Files are cut in byte ranges of ``split_bytes``, one task each. A task looks for the gzip magic in its range, inflates the first bytes
of each candidate and takes it for a record if a WARC header with a sound length comes out and the member ends at the end of the file or
where another record begins. It owns the records that start in its range and reads beyond its end to finish the last one. So
every record is read once, wherever the cuts are.

Defined cases: a null payload is empty; a null page id is written as such and never becomes the response others refer to; repeated
rows (same page id and payload) are all responses; line breaks in a URL are escaped; an empty table gives no file and no record.
Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from twinweave.llm.files import Reader, Writer, splits
from twinweave.llm.words import slices
from twinweave.session import durable, fresh_dir

LEAST_BYTES = 1000
FILE_BYTES = 128 << 20
SPLIT_BYTES = 4 << 20
_MAGIC = b"\x1f\x8b\x08"
_HEAD = 1 << 16  # bytes of a record within which its header ends
_STEP = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "path string, offset long, page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda p: f"<urn:page:{'none' if p is None else p}>"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(refers)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode()) + press.compress(block + b"\r\n\r\n") + press.flush()


def _written(folder: str, file_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, records = Writer(folder, ".warc.gz"), [], 0
        for part in slices(batches, "html"):
            columns = [part.column(c).to_pylist() for c in ("id", "url", "html", "digest", "refers", "revisit")]
            for page, url, html, digest, refers, revisit in zip(*columns):
                now.write(_record(page, url, (html or "").encode(), digest, refers, revisit, date))
                records += 1
                if now.size >= file_bytes:
                    now.close()
                    done.append((now.uri, now.size, records))
                    now, records = Writer(folder, ".warc.gz"), 0
        now.close()
        if now.size:
            done.append((now.uri, now.size, records))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "size", "records"])
    return run


def write(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES,
          file_bytes: int = FILE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write archives below ``folder`` (default: a new one in the shared folder, which goes when this process ends);
    returns their ``path, size, records``."""
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html")).withColumn(
        "digest", F.sha1(F.col("html").cast("binary")))
    again = durable(rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("n")).where(
        "n > 1 and top is not null").select(F.col("digest").alias("again"), "top"))
    marked = rows.join(again, F.col("digest") == F.col("again"), "left").withColumn(
        "revisit", F.col("top").isNotNull() & F.coalesce(F.col("id") < F.col("top"), F.lit(True)))
    ready = marked.select("id", "url", "html", "digest", F.when(F.col("revisit"), F.col("top")).alias("refers"), "revisit")
    return durable(ready.mapInArrow(_written(folder or fresh_dir(spark, "warc"), file_bytes, date), "path string, size long, records long"))


class _Range:
    """Bytes of a file from ``start`` on, read in steps as they are asked for."""

    def __init__(self, file: Reader, start: int, stop: int):
        self.file, self.start, self.data = file, start, bytearray(file.range(start, stop + len(_MAGIC) - 1))

    def upto(self, end: int) -> None:
        while self.start + len(self.data) < end and self.start + len(self.data) < self.file.size:
            at = self.start + len(self.data)
            self.data += self.file.range(at, at + _STEP)


def _member(source: _Range, at: int, head_only: bool) -> tuple[bytes, int] | None:
    """The inflated member that starts at ``at`` and where it ends, or None if none starts there."""
    engine, out, pos = zlib.decompressobj(31), [], at
    while not engine.eof:
        source.upto(pos + 1)
        piece = bytes(source.data[pos - source.start:pos - source.start + _STEP])
        if not piece:
            return None
        try:
            out.append(engine.decompress(piece, _HEAD if head_only else 0))
        except zlib.error:
            return None
        pos += len(piece)
        head = b"".join(out[:16])
        if head_only and len(head) >= 5:
            break
        if not head.startswith(b"WARC/"[:len(head)]):
            return None
    return b"".join(out), pos - len(engine.unused_data)


def _begins(source: _Range, at: int) -> bool:
    begun = _member(source, at, head_only=True)
    return bool(begun) and begun[0].startswith(b"WARC/")


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/\d\.\d", lines[0]):
        return None
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        return None
    return fields, rest[:-4]


def records_in(uri: str, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of every record that starts in ``start..stop``."""
    file = Reader(uri)
    try:
        source, at = _Range(file, start, stop), start
        while True:
            found = source.data.find(_MAGIC, at - start)
            if found < 0 or start + found >= stop:
                return
            at = start + found
            whole = _member(source, at, head_only=False) if _begins(source, at) else None
            parsed = _parsed(whole[0]) if whole else None
            if parsed and (whole[1] >= file.size or _begins(source, whole[1])):
                yield at, *parsed
                at = whole[1]
                continue
            at += 1
    finally:
        file.close()


def _page(name: str) -> int | None:
    got = re.fullmatch(r"<urn:page:(-?\d+)>", name)
    return int(got[1]) if got else None


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop"))):
                rows, held = [], 0
                for offset, fields, block in records_in(path, start, stop):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                    if kind == "response":
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if digest != stated:
                            raise ValueError(f"damaged payload in {path} at {offset}")
                    else:
                        size, digest = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1]), stated
                    kept = payload if with_payload and kind == "response" else None
                    rows.append((path, offset, _page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, size, digest, _page(fields.get("warc-refers-to", "")), kept))
                    held += len(kept or b"") + 200
                    if held > _STEP * 4:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def read(archives: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The response and revisit records of archives (``path, size``), in columns ``RECORDS``.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload, also for a revisit; a response is checked against its digest.
    """
    if split_bytes < 1:
        raise ValueError("a split has at least one byte")
    return splits(archives, split_bytes).mapInArrow(_read(with_payload), RECORDS)
