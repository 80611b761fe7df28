"""WARC archives as tables of record chunks.

A record is a run of rows (record id, chunk number, bytes): chunk 0 holds the
WARC header block and the first payload bytes, later chunks the rest, and each
row carries the SHA-1 of the payload up to its end.  The bytes of an archive's
rows in order are a valid WARC/1.1 file; :func:`export` streams them into one.
Everything that is read back comes from those bytes: ids, type, lengths and
digest from the header block, the digest and length again from the payload.
Payloads are cut as they are written and hashed chunk by chunk as they are
read, so no task builds a whole record.

Defined results: a null payload counts as empty; of records with equal
payloads the one with the largest id is the response, which all rows of that id
and payload are, and the others revisit it; payloads below ``min_bytes`` are
always responses; a null id is smaller than others; an empty table gives an
empty archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, sub_batches

#: Payload bytes of one chunk row.
CHUNK = 256 * 1024
#: Payloads of fewer bytes are never revisits.
MIN_BYTES = 0
CRLF = b"\r\n"

#: Repeated digests up to this count, some 100 bytes each, are broadcast; more meet the pages in a shuffle.
BROADCAST_DIGESTS = 400_000

ROWS = "record_id string, chunk_no int, last boolean, head_bytes int, sha1 string, data binary"


def base32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def plan(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", min_bytes: int = MIN_BYTES, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """Each page with its digest, record type and the record it refers to.

    Largest ids are found for digests, a row for each digest and task, and only
    digests that occur again meet the pages; up to ``broadcast_digests`` of them
    go to the pages, so that no payload is shuffled.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    own = pages.select(F.col(id_col).alias("id"), (F.col(url_col) if url_col else F.lit(None)).cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    light = pages.select(F.col(id_col).alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= min_bytes)
    again = light.groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("r_digest"), "response")
    again = materialise(again, "repeated")
    met = own.join(F.broadcast(again) if again.count() <= broadcast_digests else again, (F.col("digest") == F.col("r_digest")) & (F.col("size") >= min_bytes), "left")
    revisit = F.col("r_digest").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    return met.select("id", "url", "size", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("body"))


def _record_id(page_id, digest: str) -> str:
    """A record's name: its page and payload; a null id is no id."""
    return f"<urn:lectern:page:{'' if page_id is None else 'id=' + quote(str(page_id), safe='')}:{digest}>"


def _page_id(record_id: str) -> str | None:
    own = record_id.removeprefix("<urn:lectern:page:").rpartition(":")[0]
    return unquote(own.removeprefix("id=")) if own else None


def header(page_id, url: str | None, kind: str, refers_to, digest: str, length: int, size: int) -> bytes:
    """The WARC header block of a record of ``length`` bytes for a payload of ``size``."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32(digest)}",
    ]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Payload-Length: {size}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, "Content-Type: text/html", f"Content-Length: {length}", "", ""]).encode()


def parse_header(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def chunk_rows(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Planned pages to chunk rows; a batch is given out for about every 4 MB."""
    names = ["record_id", "chunk_no", "last", "head_bytes", "sha1", "data"]
    types = [pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.binary()]
    for batch in sub_batches(batches, "body"):
        rows, held = [], 0
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        col = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
        for i in range(batch.num_rows):
            page, url, size, digest, kind, to = (col[k][i].as_py() for k in ("id", "url", "size", "digest", "record_type", "refers_to"))
            body = memoryview(col["body"][i].as_buffer())
            head = header(page, url, kind, to, digest, len(body), size)
            running, n = hashlib.sha1(usedforsecurity=False), max(1, -(-len(body) // chunk))
            for k in range(n):
                part = body[k * chunk : (k + 1) * chunk]
                running.update(part)
                data = (head if k == 0 else b"") + bytes(part) + (CRLF + CRLF if k == n - 1 else b"")
                rows.append((_record_id(page, digest), k, k == n - 1, len(head) if k == 0 else 0, running.hexdigest(), data))
                held += len(data)
                if held > 4 << 20:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)


def records(planned: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The archive's chunk rows."""
    return planned.mapInArrow(lambda it: chunk_rows(it, chunk), ROWS)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows in order to one row a record, hashing as the bytes pass."""
    running, head, size = None, None, 0
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        out: list[tuple] = []
        col = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
        for i in range(batch.num_rows):
            data = memoryview(col["data"][i].as_buffer())
            if col["chunk_no"][i].as_py() == 0:
                cut = col["head_bytes"][i].as_py()
                head, data, running, size = parse_header(bytes(data[:cut])), data[cut:], hashlib.sha1(usedforsecurity=False), 0
            last = col["last"][i].as_py()
            part = data[: len(data) - 4] if last else data
            running.update(part)
            size += len(part)
            if running.hexdigest() != col["sha1"][i].as_py():
                raise ValueError(f"digest of {col['record_id'][i]} differs at chunk {col['chunk_no'][i]}")
            if last:
                kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                if size != int(head["content-length"]) or kind == "response" and base32(running.hexdigest()) != digest:
                    raise ValueError(f"record {col['record_id'][i]} does not agree with its header")
                to = head.get("warc-refers-to")
                out.append((_page_id(head["warc-record-id"]), int(head.get("payload-length", size)), digest, kind, _page_id(to) if to else None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def read(archive: DataFrame, id_type: str = "long") -> DataFrame:
    """Records read back and verified: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Records of one chunk are read where they lie; only chunks of longer ones
    are brought together, by record and in order.
    """
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    short = archive.where("chunk_no = 0 and last").mapInArrow(_verified, schema)
    # repeated rows of one record give equal chunks: numbering them keeps their chunks apart
    long = archive.where("not (chunk_no = 0 and last)")
    long = long.withColumn("copy", F.expr("row_number() over (partition by record_id, chunk_no order by sha1)"))
    order = ["record_id", "copy"]
    long = long.repartition(*order).sortWithinPartitions(*order, "chunk_no")
    found = short.unionByName(long.mapInArrow(_verified, schema))
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def export(rows: Iterator, out: io.RawIOBase) -> int:
    """Write ordered chunk rows as a WARC file; returns the bytes written."""
    total = 0
    for row in rows:
        total += out.write(bytes(row["data"]))
    return total
