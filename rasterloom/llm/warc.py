"""WARC archives of gzip members: a writer, and a reader that splits archives by byte ranges.

Reader: a task owns the records that start inside its range. It looks for gzip magic, validates a candidate by decoding
its head (a gzip header of known flags, then a WARC version line), reads on from member to member, and looks for magic
again only where a member does not follow its predecessor. The last record is read to its end beyond the range; of a
record that is long, what was decoded is let go of. A payload that holds a gzip WARC of its own is safe as long as its
member is deflated, not stored; the writer's payloads are UTF-8, in which the magic does not occur.

Writer: one archive for each task and `rotate` bytes, under a fresh name: a task that runs again leaves an archive that
no manifest lists. Records with payloads equal in bytes, of at least `least` bytes, are written once: the one with the
smallest id as response, others as revisit records without a body. Rows that share that smallest id and payload are all
responses. A null payload is empty; a record with a null id may revisit another and is never referred to. Archives go to the
folder given, through any file system that pyarrow opens.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
MOST_TASKS = 20_000
SALTS = 32
RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary, path string, offset long"
MANIFEST = "path string, bytes long, records long"
_ID = re.compile(r"<urn:page:(-?\d+)>")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def record(page_id: int | None, url: str | None, body: bytes, digest: str, first: int | None) -> bytes:
    """One record as a gzip member; first: the id of the response that it revisits."""
    head = ["WARC/1.1", "WARC-Type: response" if first is None else "WARC-Type: revisit"]
    head.append(f"WARC-Record-ID: <urn:page:{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="/:?#[]@!$&'()*+,;=%-._~", errors="replace"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(body)}"]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
        body = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str, rotate: int) -> Iterator[pa.RecordBatch]:
    system, root = _open(folder)
    done, out, path, size, records = [], None, "", 0, 0
    for batch in batches:
        for row in range(batch.num_rows):
            page_id, url, html, digest, first = (batch.column(k)[row].as_py() for k in range(5))
            if out is None:
                path = f"pages-{uuid.uuid4().hex}.warc.gz"
                out, size, records = system.open_output_stream(f"{root}/{path}", compression=None), 0, 0
            member = record(page_id, url, (html or "").encode(), digest, first)
            out.write(member)
            size, records = size + len(member), records + 1
            if size >= rotate:
                out.close()
                done.append((f"{folder}/{path}", size, records))
                out = None
    if out is not None:
        out.close()
        done.append((f"{folder}/{path}", size, records))
    yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])


def write_archives(pages: DataFrame, folder: str, least: int = 100, rotate: int = 1 << 30) -> DataFrame:
    """Write pages(page_id, url, html); returns the manifest, which has to be materialised once before it is used."""
    digested = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    long_enough = F.octet_length(F.coalesce("html", F.lit(""))) >= least
    # Only payloads that are there twice are joined, one row each, and counts are folded before they move. Where the join deals
    # payloads out, the copies of a page go to SALTS keys.
    firsts = digested.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    salted = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    marked = digested.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).join(salted, ["digest", "salt"], "left")
    marked = marked.withColumn("first", F.when(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.col("first")))
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    return marked.select("page_id", "url", "html", "digest", "first").mapInArrow(partial(_write, folder=folder, rotate=rotate), MANIFEST)


class _Source:
    """Bytes of a file from a position on, read in chunks; what lies before the position is read again if it is asked for."""

    def __init__(self, file: pa.NativeFile, at: int, size: int) -> None:
        self.file, self.base, self.size, self.held = file, at, size, bytearray()

    def upto(self, end: int) -> None:
        """Hold the bytes up to `end`, or to the end of the file."""
        while self.base + len(self.held) < min(end, self.size):
            self.file.seek(self.base + len(self.held))
            more = self.file.read(CHUNK)
            if not more:
                self.size = self.base + len(self.held)
                return
            self.held += more

    def drop(self, at: int) -> None:
        if at - self.base >= CHUNK:
            del self.held[: at - self.base]
            self.base = at

    def peek(self, at: int, n: int) -> bytes:
        if at < self.base:
            self.base, self.held = at, bytearray()
        self.upto(at + n)
        return bytes(self.held[at - self.base : at - self.base + n])


def _member(source: _Source, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at `at`, and where it ends; None if what is there is no record."""
    opened = zlib.decompressobj(31)
    content, pos = bytearray(), at
    try:
        while not opened.eof:
            piece = source.peek(pos, 1 << 16)
            if not piece:
                return None
            content += opened.decompress(piece)
            pos += len(piece)
            if len(content) >= 7:
                if not content.startswith(b"WARC/1."):
                    return None
                source.drop(pos)
    except zlib.error:
        return None
    return (bytes(content), pos - len(opened.unused_data)) if content.startswith(b"WARC/1.") else None


def _parse(content: bytes) -> tuple[dict[str, str], bytes] | None:
    head, gap, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    return (fields, rest[: int(length)]) if gap and length.isdigit() and len(rest) >= int(length) else None


def read_range(path: str, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, body) of the records that start in start .. end - 1."""
    system, inner = _open(path)
    with system.open_input_file(inner) as file:
        source = _Source(file, start, file.size())
        at = start
        while at < min(end, source.size):
            source.drop(at)
            if source.peek(at, 3) == MAGIC and (got := _member(source, at)) and (parsed := _parse(got[0])):
                yield at, *parsed
                at = got[1]
                continue
            # Not at a record: look for the next magic, in what is held and in what follows.
            source.peek(at, 3)
            found = source.held.find(MAGIC, at - source.base + 1)
            if found >= 0:
                at = source.base + found
            else:
                at = max(at + 1, source.base + len(source.held) - 2)
                source.upto(at + CHUNK)


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())])
    for batch in batches:
        for row in range(batch.num_rows):
            path, start, end = (batch.column(k)[row].as_py() for k in range(3))
            rows, held = [], 0
            for offset, fields, body in read_range(path, start, end):
                kind = fields.get("warc-type")
                own, other = _ID.fullmatch(fields.get("warc-record-id", "")), _ID.fullmatch(fields.get("warc-refers-to", ""))
                full = kind != "revisit"
                digest = hashlib.sha256(body).hexdigest() if full else fields.get("warc-payload-digest", "").removeprefix("sha256:")
                length = len(body) if full else int(n) if (n := fields.get("x-payload-length", "")).isdigit() else None
                rows.append((int(own[1]) if own else None, fields.get("warc-target-uri"), kind, digest, length, int(other[1]) if other else None, body if payloads and full else None, path, offset))
                held += len(body)
                if held >= CHUNK << 2 or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def read_archives(files: DataFrame, split: int | None = None, payloads: bool = True) -> DataFrame:
    """files(path, bytes) to RECORDS rows; each split of `split` bytes is a row of its own and read by itself. Where none is
    given, splits have 8 MiB, or more where that would make over MOST_TASKS tasks."""
    if split is None:
        split = max(8 << 20, -(-int(files.agg(F.sum("bytes")).first()[0] or 0) // MOST_TASKS))
    total = files.agg(F.sum(F.ceil(F.col("bytes") / F.lit(split)))).first()[0] or 1
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {split}L)")).alias("start")).select("path", "start", F.least(F.col("start") + split, F.col("bytes")).alias("end"))
    return ranges.repartition(int(total), "path", "start").mapInArrow(partial(_read, payloads=payloads), RECORDS)


def list_archives(spark, path: str) -> DataFrame:
    """files(path, bytes) below a path that Spark's readers can list, for read_archives."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
