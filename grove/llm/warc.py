"""WARC archives: a writer, and a reader that splits compressed files at any byte."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table, work_dir

MAGIC = b"\x1f\x8b\x08"
SHORTEST = 100  # bytes of a payload from which a repeat becomes a revisit
SPLIT = 8 << 20  # bytes of an archive that one task scans
TASKS = 100_000  # most tasks of a read; each then scans several ranges
READ = 1 << 20
ROWS = 256  # rows that a task holds as Python objects
SMALL = 200_000  # repeated payloads up to which the pages stay where they are
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str, write: bool = False):
    """A stream in whatever store the URI names."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if not write:
        return store.open_input_file(path)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def _member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in headers if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def _urn(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit that names the response."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", page_id), ("X-Payload-Length", len(payload))]
    if kind == "revisit":
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to)), ("X-Refers-To-Page", refers_to)]
    return _member(headers, http + payload if kind == "response" else http)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A record for each row, an archive for each task under ``folder``; returns ``path,
    bytes, records`` of the archives.

    Of rows with equal payloads of ``SHORTEST`` bytes or more, that with the smallest id is
    the response, the others are revisits of it; shorter payloads are all responses. Rows
    that share that smallest id are all responses, rows without an id revisits, unless no
    row of the payload has one. A null html is an empty payload, a null url is left out.
    An archive has a new name at each attempt and the returned table names those of
    attempts that succeeded, so lost executors leave no archive twice.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    repeated = rows.where(F.col("size") >= SHORTEST).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = materialize(repeated, "repeated")
    side = F.broadcast(repeated) if repeated.count() <= SMALL else repeated  # beyond it, both sides are shuffled
    refers = F.when((F.col("size") >= SHORTEST) & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.join(side, "digest", "left").select("id", "url", "html", "digest", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for number, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns), strict=True):
                    if out is None:
                        out = _open(path, write=True)
                        size += out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date)], b""))
                    size += out.write(record(number, url, html.encode(), digest, refers_to, date))
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    rows = rows.withColumns({c: F.col(c).cast("long") for c in ("id", "refers_to")})
    return materialize(rows.mapInArrow(write, "path string, bytes long, records long"), "archives")


class _Window:
    """Bytes of a file from some place on, read as they are asked for."""

    def __init__(self, source, start: int):
        self.source, self.at, self.data, self.used = source, start, b"", 0
        source.seek(start)

    def more(self) -> bool:
        got = self.source.read(READ)
        self.data, self.used = self.data[self.used :] + got, 0
        return bool(got)

    def drop(self, n: int) -> None:
        self.used, self.at = self.used + n, self.at + n

    def find(self, what: bytes) -> int:
        """How far off ``what`` is, or -1."""
        place = self.data.find(what, self.used)
        return place - self.used if place >= 0 else -1

    def left(self) -> int:
        return len(self.data) - self.used

    def part(self, a: int, b: int) -> memoryview:
        return memoryview(self.data)[self.used + a : self.used + b]


def _decoded(window: _Window) -> tuple[bytes, int] | None:
    """The WARC record that the gzip member at the start of the window holds, and the
    member's size; None if there is no such member. A member that begins otherwise is given
    up after its first bytes."""
    unpack, out, fed, step = zlib.decompressobj(31), b"", 0, 512
    parts: list[bytes] = []
    try:
        while not unpack.eof:
            if fed == window.left() and not window.more():
                return None
            part = window.part(fed, fed + step)
            fed, step = fed + len(part), READ
            parts.append(unpack.decompress(part))
            if len(out) < 7:
                out = b"".join(parts)[:7]
                if not b"WARC/1.".startswith(out):
                    return None
    except zlib.error:
        return None
    return b"".join(parts), fed - len(unpack.unused_data)


def records(source, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record whose member starts at ``start`` or later and
    before ``end``; the last one may be read beyond ``end``.

    A place that looks like a gzip header is a member only if what it holds begins like a
    WARC record; anything else is scanned on from the next byte.
    """
    window = _Window(source, start)
    while window.at < end:
        place = window.find(MAGIC)
        if place < 0:
            window.drop(max(0, window.left() - len(MAGIC) + 1))
            if not window.more():
                return
            continue
        window.drop(place)
        if window.at >= end:
            return
        whole = _decoded(window)
        head, found, body = whole[0].partition(b"\r\n\r\n") if whole else (b"", b"", b"")
        lines = [line.partition(": ") for line in head.decode("utf-8", "replace").split("\r\n")[1:]]
        headers = {k.lower(): v for k, _, v in lines}
        if not found or not headers.get("content-length", "").isdigit():
            window.drop(1)
            continue
        yield headers, body[: int(headers["content-length"])]
        window.drop(whole[1])


def read_archives(archives: DataFrame, split: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """Responses and revisits of archives (``path, bytes``), read by ranges of ``split`` bytes.

    Each range is a row that any task can take; a record belongs to the range it starts in.
    Returns ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, valid`` and
    the ``payload`` (null for revisits). Size and digest of a response are those of the
    payload that was read, and ``valid`` says whether they are what its headers name; a
    revisit has what its headers name.
    """
    ranges = archives.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid", *["payload"] * with_payload]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), *[pa.binary()] * with_payload]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start in ((p, s) for batch in batches for p, s in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            out, held = [], 0
            with _open(path) as source:
                for h, block in records(source, start, start + split):
                    kind = h.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    named, size = h.get("warc-payload-digest", "").removeprefix("sha256:"), int(h.get("x-payload-length", -1))
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    digest, n = (named, size) if payload is None else (hashlib.sha256(payload).hexdigest(), len(payload))
                    number = lambda k: int(h[k]) if k in h else None  # noqa: E731, B023
                    out.append((number("x-page-id"), h.get("warc-target-uri"), n, digest, kind, number("x-refers-to-page"), digest == named and n == size, *[payload] * with_payload))
                    held += n if with_payload else 0
                    if len(out) >= 4096 or held > 16 * READ:
                        yield made(out)
                        out, held = [], 0
            if out:
                yield made(out)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, valid boolean"
    # A number, so that ranges, which are a few bytes each, aren't put together again.
    tasks = min(max(ranges.count(), 1), TASKS)
    return ranges.repartition(tasks, "path", "start").mapInArrow(read, schema + ", payload binary" * with_payload)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as archives and read back."""
    folder = f"{work_dir(spark)}/grove-warc-{uuid.uuid4().hex}"
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "valid")


# The query's rows without archives: what was written is what is read.
OP8_SQL = f"""
with payloads as (select page_id, url, coalesce(html, '') as html from pages),
digests as (select *, sha256(html) as payload_digest, cast(strlen(html) as bigint) as payload_bytes from payloads),
firsts as (select *, case when payload_bytes >= {SHORTEST} then min(page_id) over (partition by payload_digest) else page_id end as first from digests)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to, url, true as valid
from firsts"""
