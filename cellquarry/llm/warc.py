"""WARC archives: a writer with revisit records and a splittable reader.

The writer makes a gzip member per record.  A task writes one file under a name
of its own attempt, and the archive is the list of files that successful tasks
return, so a task that is run again leaves nothing to be read twice.

The reader cuts files into byte ranges.  A task looks for the gzip magic inside
its range, takes a candidate for a record only if the member decodes to a WARC
header, and owns the records that start inside its range, reading beyond the end
to finish the last one.  After a record the next is expected right behind it;
if there is none, the search goes on, so damage costs only the damaged bytes.
Files are opened with pyarrow's file systems by their URI.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import new_path, stored

#: Equal payloads of at least so many bytes are written once.
REVISIT_BYTES = 1000
RANGE_BYTES = 16 << 20
#: Up to so many reader tasks a range has a task of its own; beyond, a task takes up to so many ranges.
MOST_READERS = 20_000
RANGES_PER_TASK = 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
READ_BYTES = 1 << 20
BATCH_BYTES = 16 << 20


def _record_id(page_id: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One record as a gzip member; a revisit (``refers_to`` given) leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id) if page_id is not None else f'<{uuid.uuid4().urn}>'}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"WARC-Page-Id: {page_id}")
    if url is not None:  # control characters would end the line
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Refers-To-Page-Id: {refers_to}"]
    whole = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def write(pages: DataFrame, path: str) -> DataFrame:
    """Writes an archive to the folder ``path``; returns its files (``file``, ``bytes``, ``records``).

    ``pages`` has ``page_id``, ``url`` and ``html`` (null: empty).  Of equal
    payloads of `REVISIT_BYTES` or more, the row of the largest page_id is the
    response and others revisit it; rows that repeat that page_id are responses
    too, as are all rows of a payload that has no page_id but null.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumns({"digest": F.sha1(F.col("html")), "bytes": F.octet_length("html")})
    narrow = pages.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
    heads = stored(narrow.where("n > 1 and head is not null").select("digest", "head"), "heads")
    refers = F.when((F.col("head") != F.col("page_id")) | F.col("page_id").isNull(), F.col("head"))
    rows = pages.join(heads, "digest", "left").select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", refers.cast("string").alias("refers_to"))
    null = lambda v: int(v) if isinstance(v, str) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name, out, size, n = f"{path}/part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for pdf in batches:
            for page_id, url, html, digest, refers_to in zip(*(pdf[c] for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    files, inner = pyarrow.fs.FileSystem.from_uri(name)
                    files.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    out = files.open_output_stream(inner, compression=None)
                data = record(null(page_id), url, html.encode("utf-8", "surrogatepass"), null(refers_to), digest)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [name], "bytes": [size], "records": [n]})

    return stored(rows.mapInPandas(run, "file string, bytes long, records long"), "archive")


class _Window:
    """Random access to a file through one buffer."""

    def __init__(self, source) -> None:
        self.source, self.at, self.data = source, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from ``at``; fewer only at the end of the file."""
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.source.seek(at)
            self.at, self.data = at, self.source.read(max(n, READ_BYTES))
        return self.data[at - self.at : at - self.at + n]


def parse_header(head: bytes) -> dict[str, str] | None:
    """Fields (names in lower case) of a record's header up to the blank line; null if it is none."""
    first, _, rest = head.partition(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.\d", first):
        return None
    fields = {}
    for line in rest.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "surrogatepass")
    return fields if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def member(window: _Window, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Header, block and end of the record at ``at``; null if no whole record starts there."""
    if window.get(at, 3) != MAGIC:
        return None
    unpack, parts, head, fields, place = zlib.decompressobj(31), [], bytearray(), None, at
    try:
        while not unpack.eof:
            data = window.get(place, 16384)
            if not data:
                return None
            got = unpack.decompress(data)
            place += len(data) - len(unpack.unused_data)
            if fields is not None:
                parts.append(got)
                continue
            looked = max(0, len(head) - 3)
            head += got
            if not b"WARC/1."[: len(head)] == head[:7]:
                return None
            if (start := head.find(b"\r\n\r\n", looked)) >= 0:
                if (fields := parse_header(bytes(head[:start]))) is None:
                    return None
                parts.append(bytes(head[start + 4 :]))
    except (zlib.error, UnicodeDecodeError):
        return None
    if fields is None:
        return None
    block = b"".join(parts)
    length = int(fields["content-length"])
    return (fields, block[:length], place) if len(block) >= length else None


def records(source, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records that start in [start, end) of an open file."""
    window, at = _Window(source), start
    while at < end:
        found = member(window, at)
        if found:
            yield found[0], found[1]
            at = found[2]
            continue
        at += 1
        while at < end:  # on to the next magic, whose first byte must lie in the range
            data = window.get(at, min(end - at, READ_BYTES // 2) + 2)
            hit = data.find(MAGIC)
            if 0 <= hit and at + hit < end:
                at += hit
                break
            at += max(1, len(data) - 2)
            if len(data) < 3:
                at = end


def reader_tasks(ranges: int, total: int, range_bytes: int) -> int:
    """A task for each range; beyond `MOST_READERS` tasks, each takes an equal number of ranges."""
    return max(1, min(ranges, max(MOST_READERS, -(-total // (RANGES_PER_TASK * range_bytes)))))


def read(archive: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = False) -> DataFrame:
    """A row per record of the files in ``archive`` (``file``, ``bytes``).

    ``payload_bytes`` and ``payload_digest`` (hex SHA-1) are of the full payload:
    of the bytes read for a response, of the header for a revisit.  ``url`` and,
    if wanted, ``payload`` (null for a revisit) follow.
    """
    ranges = archive.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    n, total = archive.agg(F.sum(F.greatest(F.ceil(F.col("bytes") / range_bytes), F.lit(1))), F.sum("bytes")).first()
    ranges = ranges.repartition(reader_tasks(n or 1, total or 0, range_bytes))  # a number, as the rows themselves are tiny
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        frame = lambda: pd.DataFrame(rows, columns=columns, dtype=object).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})
        columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *["payload"] * payloads]
        number = lambda text: int(text) if text is not None else None
        for pdf in batches:
            for name, start, whole in zip(pdf["file"], pdf["start"], pdf["bytes"], strict=True):
                files, inner = pyarrow.fs.FileSystem.from_uri(name)
                with files.open_input_file(inner) as source:
                    for fields, block in records(source, int(start), int(min(start + range_bytes, whole))):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind = fields["warc-type"]
                        if kind == "response":
                            length, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        else:
                            said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                            length = int(said[1]) if said else None
                            digest = base64.b32decode(fields.get("warc-payload-digest", "").removeprefix("sha1:")).hex()
                        rows.append((number(fields.get("warc-page-id")), length, digest, kind, number(fields.get("warc-refers-to-page-id")), fields.get("warc-target-uri"), *[payload if kind == "response" else None] * payloads))
                        size += len(payload) * payloads + 200
                        if size >= BATCH_BYTES:
                            yield frame()
                            rows, size = [], 0
        if rows:
            yield frame()

    return ranges.mapInPandas(run, kinds + ", payload binary" * payloads)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record, written and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archive = write(pages, new_path(spark, "warc"))
    return read(archive).drop("url")
