"""WARC archives: records with segments, chunked transfer framing and revisits, written and read by Spark.

`plan` chooses for each page its record type: of pages with equal payloads of at least `min_revisit` bytes the one
with the smallest id is a response and the others revisit it. `write` makes the records' bytes; each is a row of a
text file whose line separator is the blank lines that end a WARC record, so the part files are WARC files. A block
longer than `segment` bytes goes on in continuation records. `read` takes the files apart by Content-Length;
`reassemble` groups segments by the origin's identifier, orders them by number, verifies the total length and decodes
the chunked framing.

Digests alone are shuffled to find equal payloads, pre-aggregated by digest, so a payload that a third of all pages
share costs one row per task. A part file holds at most `records` records of at
most `segment` bytes and a header: that bounds what a reader holds.

Defined results: null html is an empty payload; repeated rows give one record each, and all rows with the smallest id
are responses; a null id sorts last; an empty table gives an empty archive and no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import check_columns, materialise, shared_dir, spread_join

END = "\r\n\r\n"
SEGMENT = 64 * 1024
CHUNK = 8 * 1024
RECORDS = 512
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str, number: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key}/{number}')}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [payload[at : at + size] for at in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are read over. Raises ValueError on broken framing."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def records(page_id: int | None, key: str, url: str | None, payload: bytes, refers_to: int | None, refers_key: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The WARC records of a page, without the blank lines at their end; a revisit has a `refers_key`."""
    revisit = refers_key is not None
    block = _HTTP if revisit else _HTTP + chunked(payload)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    uri = "".join((url or "").split()) or "urn:none"
    origin = record_id(key)
    for n, part in enumerate(parts, 1):
        head = [
            "WARC/1.1", f"WARC-Type: {'continuation' if n > 1 else 'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key, n)}",
            f"WARC-Target-URI: {uri}", "WARC-Date: 2024-01-01T00:00:00Z", f"X-Page-ID: {'' if page_id is None else page_id}",
        ]
        if n == 1:
            head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
            if revisit:
                head += [f"WARC-Refers-To: {record_id(refers_key)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if len(parts) > 1:
            head.append(f"WARC-Segment-Number: {n}")
            if n > 1:
                head.append(f"WARC-Segment-Origin-ID: {origin}")
            if n == len(parts):
                head.append(f"WARC-Segment-Total-Length: {len(block)}")
        head.append(f"Content-Length: {len(part)}")
        yield "\r\n".join(head).encode() + b"\r\n\r\n" + part


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, block
        at = end + 4 + size


def plan(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """page_id, key (of the record), url, payload, and for revisits refers_to and refers_key.

    A record's key is made of what is in it, so that it stays the same when rows are read again in another order; rows
    that are equal in all have one key. Digests and ids alone are
    shuffled; the answer to a digest that many pages share is broadcast (see `spread_join`), and payloads meet the
    answers by page and digest, so that a payload of many pages is not one task's.
    """
    check_columns(pages, "page_id", "url", "html")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    key = F.concat_ws("-", F.col("page_id"), F.col("digest"), F.sha1(F.coalesce(F.col("url"), F.lit("")).cast("binary")))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("key", key)
    thin = materialise(rows.select("page_id", "digest", "key", F.octet_length("payload").alias("size")), "warc_digests")
    first = (
        thin.where(F.col("size") >= min_revisit).groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "key")).alias("first"))
        .where("n > 1").select("digest", "n", F.col("first.page_id").alias("refers_to"), F.col("first.key").alias("refers_key"))
    )
    same = spread_join(thin.select("page_id", "digest"), materialise(first, "warc_first"), ["digest"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    answers = same.select(F.col("page_id").alias("at_id"), F.col("digest").alias("at_digest"), "refers_to", "refers_key").distinct()
    meets = F.col("page_id").eqNullSafe(F.col("at_id")) & (F.col("digest") == F.col("at_digest"))
    return rows.join(answers, meets, "left").select("page_id", "key", "url", "payload", "refers_to", "refers_key")


def write(planned: DataFrame, path: str, segment: int = SEGMENT, per_file: int = RECORDS) -> None:
    """Writes the archive: gzip-compressed WARC files below `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                columns = (c.to_pylist() for c in whole.slice(at, 256).columns)
                yield pa.RecordBatch.from_arrays([pa.array([r for row in zip(*columns) for r in records(*row, segment)], pa.binary())], ["record"])

    made = planned.select("page_id", "key", "url", "payload", "refers_to", "refers_key").mapInArrow(run, "record binary")
    made.select(F.col("record").cast("string")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records below `path`: type, origin (the first segment's identifier), number, total, page_id, ... and block."""
    import gzip

    schema = "type string, origin string, number int, total bigint, page_id bigint, uri string, digest string, length bigint, refers_to bigint, block binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["type", "origin", "number", "total", "page_id", "uri", "digest", "length", "refers_to", "block"]
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        number = lambda f, k: int(f[k]) if f.get(k) else None
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = [
                    (f["warc-type"], f.get("warc-segment-origin-id", f["warc-record-id"]), number(f, "warc-segment-number"), number(f, "warc-segment-total-length"), number(f, "x-page-id"),
                     f.get("warc-target-uri"), f.get("warc-payload-digest"), number(f, "x-payload-length"), number(f, "x-refers-to-page"), block)
                    for f, block in parse(data)
                ]
                for at in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 256]), types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return files.mapInArrow(run, schema)


def reassemble(segments: DataFrame) -> DataFrame:
    """One row for each record: `whole` (all segments are there and the total length is right), and for whole responses
    the payload without its chunked framing, its length and its digest; revisits give what their headers say.

    Records without a segment number skip the grouping; a group is the segments of one record.
    """
    single = F.col("number").isNull()
    rest = ("type", "page_id", "uri", "digest", "length", "refers_to")
    alone = segments.where(single).select(*rest, F.array("block").alias("blocks"), F.lit(True).alias("whole"))
    head = lambda c: F.max(F.when(F.col("type") != "continuation", F.col(c))).alias(c)
    # records of equal rows have equal identifiers and segments: these are counted first
    pieces = segments.where(~single).groupBy("origin", "number").agg(*[head(c) for c in rest], F.first("block").alias("block"), F.max("total").alias("total"), F.count("*").alias("copies"))
    joined = pieces.groupBy("origin").agg(*[F.max(c).alias(c) for c in rest], F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"), F.max("copies").alias("copies"), F.min("copies").alias("fewest"))
    held = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + F.octet_length(p["block"]))
    whole = F.coalesce((held == F.col("total")) & (F.get("parts", F.size("parts") - 1)["number"] == F.size("parts")) & (F.col("copies") == F.col("fewest")), F.lit(False))
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    both = alone.unionByName(joined.select(*rest, F.transform("parts", lambda p: p["block"]).alias("blocks"), whole.alias("whole")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                kinds, blocks, fine, said, lengths = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("type", "blocks", "whole", "digest", "length"))
                payloads, kept_whole, digests = [], list(fine), [(x or "").removeprefix("sha1:") or None for x in said]
                for k, (kind, block, ok) in enumerate(zip(kinds, blocks, fine)):
                    payload = None
                    if ok and kind == "response":
                        top, _, body = b"".join(block).partition(b"\r\n\r\n")
                        payload = dechunked(body) if b"transfer-encoding: chunked" in top.lower() else body
                        digest, length = payload_digest(payload), len(payload)
                        # what was read back has to be what the header says was written
                        kept_whole[k] = digests[k] in (None, digest) and lengths[k] in (None, length)
                        digests[k], lengths[k] = digest, length
                    payloads.append(payload)
                names = ["type", "page_id", "uri", "refers_to"]
                kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
                names.append("whole")
                yield pa.RecordBatch.from_arrays([*kept, pa.array(kept_whole, pa.bool_()), pa.array(digests, pa.string()), pa.array(lengths, pa.int64()), pa.array(payloads, pa.binary())], [*names, "payload_digest", "payload_bytes", "payload"])

    return both.mapInArrow(run, "type string, page_id bigint, uri string, refers_to bigint, whole boolean, payload_digest string, payload_bytes bigint, payload binary")


def archive(pages: DataFrame, min_revisit: int = 0, segment: int = SEGMENT) -> str:
    """Writes all pages to a new folder of the shared directory and returns its path."""
    path = f"{shared_dir(pages.sparkSession)}/beatspark/warc-{uuid.uuid4().hex}"
    write(plan(pages, min_revisit), path, segment)
    return path
