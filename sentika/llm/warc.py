"""Web archives: segmented records with chunked payloads, written and read back.

The writer stores a page as a ``response`` record, or as a ``revisit`` where another page has
the same payload. The HTTP body is framed in chunks; a record above ``segment_bytes`` is cut
into a first segment and ``continuation`` records. The reader parses records by their lengths,
groups continuations by origin, orders them by number, checks the total length and takes the
chunk framing off. Files go through Spark's own writer and reader, so any store will do.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentika.llm.common import written
from sentika.session import scratch_path

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
#: With the segment size, bounds an archive file: about 32 MB before compression.
RECORDS_PER_FILE = 1000
CRLF = b"\r\n"
RECORD = (
    "record_id string, type string, origin_id string, segment int, total_length long, url string, "
    "page string, refers_to string, digest string, block binary"
)
#: As read from an archive, where a record may be one of several segments.
PARSED = f"{RECORD}, segmented boolean"


def base32_of(hex40: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: five hex digits are four digits of base 32."""
    parts = [
        F.lpad(F.conv(F.substring(hex40, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in chunked transfer framing."""
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*out, b"0", CRLF, CRLF])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped, a cut body is an error."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("chunked body ends within a chunk's size")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk is not as long as it says")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, blank, body = block.partition(CRLF + CRLF)
    if not blank:
        raise ValueError("no end of the HTTP header")
    if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        return dechunked(body)
    return body


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    named = [f"{k}: {v}" for k, v in fields if v is not None]
    head = "\r\n".join(["WARC/1.1", *named, f"Content-Length: {len(block)}"])
    return head.encode() + CRLF + CRLF + block


def _clean(url: str | None) -> str | None:
    """A URL on one line: control characters are percent-encoded."""
    return None if url is None else re.sub(r"[\0-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _records(date: str, segment_bytes: int):
    """Archive records of each page, without the blank lines that end a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for r in batch.to_pylist():
                common = [
                    ("WARC-Date", date),
                    ("WARC-Target-URI", _clean(r["url"])),
                    ("Archive-Page", r["page"]),
                    ("WARC-Payload-Digest", f"sha1:{r['digest']}"),
                ]
                rid = f"<urn:uuid:{r['record_id']}>"
                if r["refers_to"] is not None:
                    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *common, ("WARC-Profile", profile)]
                    fields += [("Archive-Refers-To", r["refers_to"]), ("Content-Type", "application/http;msgtype=response")]
                    out.append(_record(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"))
                    continue
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                block = head + chunked(r["payload"] or b"")
                cuts = range(0, len(block), segment_bytes)
                for n, at in enumerate(cuts, 1):
                    part = block[at : at + segment_bytes]
                    if n == 1:
                        fields = [("WARC-Type", "response"), ("WARC-Record-ID", rid), *common]
                        fields += [("Content-Type", "application/http;msgtype=response")]
                        fields += [("WARC-Segment-Number", "1" if len(cuts) > 1 else None)]
                    else:
                        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{r['record_id']}-{n}>"), ("WARC-Date", date)]
                        fields += [("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", str(n))]
                        fields += [("WARC-Segment-Total-Length", str(len(block)) if n == len(cuts) else None)]
                    out.append(_record(fields, part))
                if len(out) >= 64:
                    yield pa.record_batch({"record": pa.array(out, pa.binary())})
                    out = []
            yield pa.record_batch({"record": pa.array(out, pa.binary())})

    return run


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write a record for each page to gzip archives below ``path``.

    Of pages with equal payloads of at least ``least_bytes``, that with the smallest id is the
    response and the others revisit it. A null payload is empty. Rows that repeat the smallest
    id are responses too; pages of a group without any id are all responses, and a row without
    an id beside others revisits. Other columns are not read.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("string").alias("page"),
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        base32_of(F.sha1(payload)).alias("digest"),
    )
    firsts = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 AND first IS NOT NULL")
        .drop("copies")
    )
    placed = rows.join(firsts, "digest", "left").select(
        "page", "url", "payload", "digest",
        F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("refers_to"),
        F.expr("uuid()").alias("record_id"),
    )
    records = placed.mapInArrow(_records(date, segment_bytes), "record binary")
    # a record ends in two line ends, which the writer sets after each row
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).option("compression", "gzip").text(path)


def _inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a plain archive, or of all gzip members of a compressed one, piece by piece."""
    if data[:2] != b"\x1f\x8b":
        for i in range(0, len(data), step):
            yield data[i : i + step]
        return
    left: bytes = data
    while left:
        member = zlib.decompressobj(31)
        piece = member.decompress(left, step)
        while piece or member.unconsumed_tail:
            yield piece
            piece = member.decompress(member.unconsumed_tail, step)
        if not member.eof:
            raise ValueError("archive ends within a compressed member")
        left = member.unused_data


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of every record of an archive file."""
    pieces, buffer = _inflated(data), b""

    def more() -> bool:
        nonlocal buffer
        piece = next(pieces, None)
        if piece is None:
            return False
        buffer += piece
        return True

    while True:
        while not buffer.lstrip(CRLF) and more():
            pass
        buffer = buffer.lstrip(CRLF)
        if not buffer:
            return
        while (end := buffer.find(CRLF + CRLF)) < 0:
            if not more():
                raise ValueError("archive ends within a record's header")
        version, *lines = buffer[:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record where one should begin")
        fields: dict[str, str] = {}
        for line in lines:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        while len(buffer) < end + 4 + size:
            if not more():
                raise ValueError("archive ends within a record")
        yield fields, buffer[end + 4 : end + 4 + size]
        buffer = buffer[end + 4 + size :]


def _reader():
    names = [f.split()[0] for f in PARSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                held = 0
                for f, block in parsed(content.as_py()):
                    kind, number = f.get("warc-type"), f.get("warc-segment-number")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    total = f.get("warc-segment-total-length")
                    rows.append(
                        {
                            "record_id": f["warc-record-id"],
                            "segmented": number is not None,
                            "type": kind,
                            "origin_id": f.get("warc-segment-origin-id", f["warc-record-id"]),
                            "segment": int(number or 1),
                            "total_length": None if total is None else int(total),
                            "url": f.get("warc-target-uri"),
                            "page": f.get("archive-page"),
                            "refers_to": f.get("archive-refers-to"),
                            "digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                            "block": block,
                        }
                    )
                    held += len(block)
                    if held > 4 << 20:
                        yield _arrow(rows, names)
                        rows, held = [], 0
                yield _arrow(rows, names)

    return run


def _arrow(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"segmented": pa.bool_(), "segment": pa.int32(), "total_length": pa.int64(), "block": pa.binary()}
    return pa.record_batch({n: pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names})


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for kind, digest, block in zip(*(batch.column(k).to_pylist() for k in (1, 5, 6)), strict=True):
            payload = None if kind == "revisit" else payload_of(block)
            if payload is not None and digest is not None and digest_of(payload) != digest:
                raise ValueError("payload does not have the digest of its record")
            out.append(payload)
        yield pa.record_batch(
            {n: batch.column(i) for i, n in enumerate(("record_id", "type", "url", "page", "refers_to"))}
            | {
                "payload": pa.array(out, pa.binary()),
                "digest": pa.array([d if p is None else digest_of(p) for p, d in zip(out, batch.column(5).to_pylist(), strict=True)], pa.string()),
            }
        )


def reassembled(segments: DataFrame) -> DataFrame:
    """Whole records of their segments: grouped by origin, in order of number, of the stated length.

    A missing or repeated segment, or a sum that is not the total length, is an error. A group
    is one record, never more.
    """
    is_first = F.col("segment") == 1
    first = lambda c: F.max(F.when(is_first, F.col(c))).alias(c)
    grouped = segments.groupBy("origin_id").agg(
        first("record_id"), first("type"), first("url"), first("page"), first("refers_to"), first("digest"),
        F.max("total_length").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"]))
    whole = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    block = F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.block))")
    failed = F.raise_error(F.concat(F.lit("segments missing of "), F.col("origin_id")))
    return grouped.select(
        "record_id", "type", "url", "page", "refers_to", "digest",
        F.when(F.coalesce(whole & (length == F.col("total")), F.lit(False)), block).otherwise(failed.cast("binary")).alias("block"),
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every response and revisit below ``path``: ``record_id type url page refers_to payload digest``.

    Payloads are verified against the digests of their records; a revisit has a null payload.
    Runs a job that parses every archive once and writes its records, whole ones and segments
    apart, to shared storage; only segments are shuffled. An archive file must fit into a task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    columns = "record_id", "type", "url", "page", "refers_to", "digest", "block"
    records = files.mapInArrow(_reader(), PARSED)
    held = scratch_path(spark, "archive-records")
    # gzip has packed these texts tightly once already: cheap compression does here
    records.write.partitionBy("segmented").option("compression", "snappy").parquet(held)
    kept = spark.read.schema(records.schema).parquet(held)
    whole = kept.where("NOT segmented").select(*columns)
    parts = reassembled(kept.where("segmented")).select(*columns)
    schema = "record_id string, type string, url string, page string, refers_to string, payload binary, digest string"
    return whole.mapInArrow(_payloads, schema).unionByName(parts.mapInArrow(_payloads, schema))


def archive_index(records: DataFrame) -> DataFrame:
    """``page payload_bytes payload_digest record_type refers_to``; revisits take the length of their response.

    The lengths are written first, so that payloads are decoded once.
    """
    own = records.select(
        "page", "refers_to", F.octet_length("payload").cast("long").alias("bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
    )
    own = written(own, "archive-lengths")
    responses = (
        own.where("record_type = 'response'")
        .groupBy(F.col("page").alias("refers_to"), "payload_digest")
        .agg(F.max("bytes").alias("referred"))
    )
    return own.join(responses, ["refers_to", "payload_digest"], "left").select(
        "page", F.coalesce("bytes", "referred").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
