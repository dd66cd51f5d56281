"""WARC archives: one gzip member a record, written from pages and read back sequentially.

Of records with equal payloads of at least `least_bytes` bytes, the one with the largest page id is the response and the
others revisit it; the duplicates are found by grouping SHA-1 digests, and only digests that repeat are joined to the pages: by
broadcast of up to BROADCAST_DIGESTS (counted first), so that payloads are not shuffled, and by shuffle beyond.
Archives are rows of a table in the shared folder, each a run of whole members of about `segment` bytes, so that any store
that Spark writes can hold them; `export` writes them as .warc.gz files.

The reader takes an archive as one stream: it inflates member after member incrementally, frames each record by its
Content-Length, and verifies block and payload digests. A truncated or altered archive raises ValueError.

Nulls and ties: null html is an empty payload. Rows that repeat the responding page id with the same payload are all
responses; rows with a null page id respond only if no row of their payload has an id. A null url is written as an empty
target. Ids may be numbers or texts. Payloads may be of any length that a task's memory holds; other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolake.llm.common import col, written

#: Fixed values of the WARC 1.1 standard.
VERSION, PROFILE = b"WARC/1.1", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"1970-01-01T00:00:00Z"
CHUNK = 1 << 16
#: At most so many repeated digests, of some 100 bytes with their ids, are broadcast.
BROADCAST_DIGESTS = 500_000


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").replace(b"\r", b"%0D").replace(b"\n", b"%0A")


def _urn(page_id) -> bytes:
    """The name of a record: a null id has one of its own, others are quoted."""
    return b"<urn:page>" if page_id is None else b"<urn:page:%s>" % quote(str(page_id), safe="").encode()


def record(page_id, url: str, payload: bytes, refers_to, record_type: str) -> bytes:
    """A record as one gzip member; a revisit carries the headers and digest of its payload, not the payload."""
    body = b"" if record_type == "revisit" else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + body
    head = [VERSION, b"WARC-Type: " + record_type.encode(), b"WARC-Record-ID: " + _urn(page_id), b"WARC-Date: " + DATE, b"WARC-Target-URI: " + _one_line(url), b"WARC-Payload-Digest: sha1:" + digest(payload).encode(), b"WARC-Block-Digest: sha1:" + digest(block).encode()]
    if record_type == "revisit":
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + _urn(refers_to)]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(data: bytes) -> Iterator[bytes]:
    """The inflated members of a gzip stream, fed to zlib in small chunks."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("truncated gzip member")
            try:
                out.append(unpack.decompress(view[at : at + CHUNK]))
            except zlib.error as e:
                raise ValueError(f"damaged gzip member: {e}") from e
            at = min(at + CHUNK, len(view)) - len(unpack.unused_data)
        yield b"".join(out)


def parse(member: bytes) -> dict:
    """Headers, HTTP headers and payload of a record, its lengths and digests verified."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "surrogatepass") for k, _, v in (x.partition(b":") for x in lines[1:])}
    length = int(fields["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) < length or tail != b"\r\n\r\n":
        raise ValueError("a record's length is not its Content-Length")
    if "sha1:" + digest(block) != fields["warc-block-digest"]:
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if fields["warc-type"] != "revisit" and ("sha1:" + digest(payload) != fields["warc-payload-digest"] or len(payload) != size):
        raise ValueError("payload digest or length differs")
    page = lambda x: unquote(fields[x][len("<urn:page:") : -1]) if fields.get(x, "").startswith("<urn:page:") else None
    return {"page_id": page("warc-record-id"), "url": fields["warc-target-uri"], "payload": payload, "payload_bytes": size, "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "record_type": fields["warc-type"], "refers_to": page("warc-refers-to")}


def _write(batches: Iterable[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    held, size, n = [], 0, 0

    def archive() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.warc.gz"]), pa.array([n], pa.int64()), pa.array([b"".join(held)], pa.large_binary() if size >= 1 << 31 else pa.binary())], ["name", "records", "content"])

    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            page, url, html, refers, kind = (x.as_py() for x in row)
            held.append(record(page, url or "", html or b"", refers, kind))
            size, n = size + len(held[-1]), n + 1
            if size >= segment:
                yield archive()
                held, size, n = [], 0, 0
    if held:
        yield archive()


def classified(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to, record_type) of each row."""
    url = col(url_col).cast("string") if url_col else F.lit("")
    src = pages.select(col(id_col).alias("page_id"), url.alias("url"), F.coalesce(col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    same = src.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha1", "last")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    same = written(same, "digests")
    out = src.join(F.broadcast(same) if same.count() <= BROADCAST_DIGESTS else same, "sha1", "left")
    return out.select("page_id", "url", "payload", F.when(revisit, F.col("last")).alias("refers_to"), F.when(revisit, "revisit").otherwise("response").alias("record_type"))


def write_archives(pages: DataFrame, segment: int = 16 << 20, **kind) -> DataFrame:
    """(name, records, content): the archives of `pages`, written to the shared folder."""
    return written(classified(pages, **kind).mapInArrow(functools.partial(_write, segment=segment), "name string, records long, content binary"), "warc")


def _read(batches: Iterable[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * keep]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for member in members(content.as_py() or b""):
                rows.append(parse(member))
                size += len(rows[-1]["payload"])
                if len(rows) == 1000 or size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)], names)


def read_archives(archives: DataFrame, content_col: str = "content", keep_payload: bool = True) -> DataFrame:
    """The records of archives, one row each; page ids as text."""
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * keep_payload
    return archives.select(col(content_col)).mapInArrow(functools.partial(_read, keep=keep_payload), schema)


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), each row read back from the archives."""
    kind: T.DataType = pages.schema["page_id"].dataType
    number = lambda c: F.col(c).cast(kind).alias(c)
    read = read_archives(write_archives(pages, least_bytes=least_bytes), keep_payload=False)
    return read.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


def _export(batches: Iterable[pa.RecordBatch], to: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(to)
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(content.as_py())
        yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])


def export(archives: DataFrame, to: str) -> DataFrame:
    """Writes each archive as a file under `to`, a URI that pyarrow and all executors reach (file://, hdfs://, s3://)."""
    return archives.select("name", "content").mapInArrow(functools.partial(_export, to=to), "name string")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS last, count(*) OVER (PARTITION BY h) AS n FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM d
"""
