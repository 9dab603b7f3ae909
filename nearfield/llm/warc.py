"""WARC archives: writing pages as segmented records, and reading them back whole.

Writing. A page is a response record, or a revisit record if a later page has the same payload. The
block of a response is an HTTP head and the payload in chunked framing; blocks over ``SEGMENT`` bytes
are cut into a first record (WARC-Segment-Number 1) and continuation records that name it as their
origin, the last of which gives the total length. All of it is Spark expressions; the text writer
ends each record with the two line ends that the format asks for. Files are compressed by gzip.

Reading. Archives are parsed record by record. Segments are grouped by the id of their origin,
ordered by number and joined; missing numbers or another total length than the given one are
errors. Then the HTTP head is cut off and chunks are decoded. Revisits get what their response has.

Defined results. Null html is an empty payload; null url and page_id are left out of the record.
Of rows with equal payload and page_id, all that hold the largest page_id are responses. A null
page_id is the least of all. Further columns, whatever their names, are not archived. A payload of any length is
written and read in time and memory in proportion to it; a record is held whole by the task that reads it. An empty
table makes no records and no rows.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm._files import read_files, write_records
from nearfield.llm._shared import arrow_batches, new_path, stage

#: Bytes of a segment, of a chunk; records of an archive file (so some 16 MB at most); payloads of fewer bytes are never revisits.
SEGMENT, CHUNK, FILE_RECORDS, LEAST_REVISIT = 16 << 10, 8 << 10, 1000, 0

END = "\r\n\r\n"
_LINE = "\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1: five bytes make eight digits, four times over."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _binary(*parts: Column | str) -> Column:
    return F.concat(*[(F.lit(p) if isinstance(p, str) else p).cast("binary") for p in parts])


def _pieces(block: Column, size: int) -> Column:
    """The block in pieces of `size` bytes; one empty piece for an empty block."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(block) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(block, i * size + 1, F.lit(size)))


def _chunked(payload: Column) -> Column:
    """The payload in HTTP chunks with the closing empty one."""
    framed = F.transform(_pieces(payload, CHUNK), lambda c: F.when(F.octet_length(c) > 0, _binary(F.hex(F.octet_length(c).cast("long")), _LINE, c, _LINE)).otherwise(_binary("")))
    # A string keeps its bytes as they are, and joining an array of them copies each once.
    joined = F.array_join(F.transform(framed, lambda c: c.cast("string")), "").cast("binary")
    return _binary(joined, "0\r\n\r\n")


def plan(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, and the response that a revisit refers to.

    The join with each payload's response is one that AQE splits, as many pages may share a payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", sha1_base32(F.col("payload"))).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    # Only digests that several rows share need the join.
    shared = rows.select("page_id", "digest", "n_bytes").where(F.col("n_bytes") >= least_revisit).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("response")).where("n > 1").select("digest", "response")
    shared = stage(shared, "warc-shared")  # read from files, the join has two plain exchanges, which AQE can split
    refers = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return rows.join(shared, "digest", "left").withColumn("refers_to", refers).drop("response")


def records(planned: DataFrame) -> DataFrame:
    """The WARC records of planned pages, a binary column `record`; segments of a page are rows of their own."""
    rid = F.concat(F.lit("<urn:x-record:"), F.uuid(), F.lit(">"))
    page = F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string"), F.lit(_LINE))).otherwise("")
    url = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"\s", "%20"), F.lit(_LINE))).otherwise("")
    refers = F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nX-Refers-To-Page-ID: "), F.col("refers_to").cast("string"), F.lit(_LINE))).otherwise("")
    is_revisit = F.col("refers_to").isNotNull()
    head = F.when(is_revisit, _binary("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"))
    block = head.otherwise(_binary("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n", _chunked(F.col("payload"))))
    rows = planned.select(rid.alias("rid"), page.alias("page"), url.alias("url"), refers.alias("refers"), is_revisit.alias("is_revisit"), "digest", block.alias("block"))
    rows = rows.select("rid", "page", "url", "refers", "is_revisit", "digest", F.octet_length("block").alias("total"), F.posexplode(_pieces(F.col("block"), SEGMENT)).alias("i", "piece"))
    several = F.col("total") > SEGMENT
    last = F.col("i") == F.ceil(F.col("total") / SEGMENT) - 1
    first = F.concat(F.lit("WARC-Type: "), F.when(F.col("is_revisit"), "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), F.col("rid"), F.lit(_LINE), F.col("page"), F.col("url"), F.col("refers"), F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nContent-Type: application/http;msgtype=response\r\n"))
    more = F.concat(F.lit("WARC-Type: continuation\r\nWARC-Record-ID: <urn:x-record:"), F.uuid(), F.lit(">\r\nWARC-Segment-Origin-ID: "), F.col("rid"), F.lit(_LINE))
    total = F.when(several & last, F.concat(F.lit("WARC-Segment-Total-Length: "), F.col("total").cast("string"), F.lit(_LINE))).otherwise("")
    number = F.when(several, F.concat(F.lit("WARC-Segment-Number: "), (F.col("i") + 1).cast("string"), F.lit(_LINE))).otherwise("")
    text = F.concat(F.lit("WARC/1.1\r\n"), F.when(F.col("i") == 0, first).otherwise(more), number, total, F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: "), F.octet_length("piece").cast("string"), F.lit(END))
    return rows.select(_binary(text, F.col("piece")).alias("record"))


def write(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT) -> None:
    write_records(records(plan(pages, least_revisit)), "record", path, END, FILE_RECORDS, "gzip")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: headers (names in lower case) and block."""
    at = 0
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        at = start + int(headers["content-length"])
        if content[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"{headers.get('warc-record-id')}: the block is not followed by two line ends")
        yield headers, content[start:at]
        at += 4


def dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n
        if len(out[-1]) != n or body[at : at + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    chunked = any(x.split(b":")[0].strip().lower() == b"transfer-encoding" and b"chunked" in x.lower() for x in head.split(b"\r\n")[1:])
    return dechunk(body) if chunked else body


_PARSED = "record_id string, kind string, origin string, segment int, total long, page_id long, url string, refers_to long, digest string, data binary"
_PARSED_ARROW = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("data", pa.binary())])


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    """One row per record. ``data`` is the payload of a whole record, else the segment's block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows, held = [], 0
                for h, block in parse(content):
                    number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                    segmented = "warc-segment-number" in h
                    rows.append({
                        "record_id": h["warc-record-id"], "kind": h["warc-type"], "origin": (h.get("warc-segment-origin-id") or h["warc-record-id"]) if segmented else None,
                        "segment": number("warc-segment-number"), "total": number("warc-segment-total-length"), "page_id": number("x-page-id"), "url": h.get("warc-target-uri"),
                        "refers_to": number("x-refers-to-page-id"), "digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None, "data": block if segmented else payload_of(block),
                    })
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_PARSED_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PARSED_ARROW)

    return read_files(spark, path).select("content").mapInArrow(run, _PARSED)


def _reassembled(segments: DataFrame) -> DataFrame:
    """Segments joined to whole records by the id of their origin, with verified length and decoded payload."""
    parts = F.array_sort(F.collect_list(F.struct("segment", "data")))
    grouped = segments.groupBy("origin").agg(
        parts.alias("parts"), F.max("total").alias("total"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("kind", "page_id", "url", "refers_to", "digest")],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                numbers = [p["segment"] for p in r["parts"]]
                block = b"".join(p["data"] for p in r["parts"])
                if numbers != list(range(1, len(numbers) + 1)) or r["total"] != len(block):
                    raise ValueError(f"{r['origin']}: segments {numbers[:20]} of {len(block)} bytes, {r['total']} expected")
                out.append({"record_id": r["origin"], "kind": r["kind"], "page_id": r["page_id"], "url": r["url"], "refers_to": r["refers_to"], "digest": r["digest"], "data": payload_of(block)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([_PARSED_ARROW.field(n) for n in ("record_id", "kind", "page_id", "url", "refers_to", "digest", "data")]))

    return grouped.mapInArrow(run, "record_id string, kind string, page_id long, url string, refers_to long, digest string, data binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder, whole: record_id, kind, page_id, url, refers_to, digest, payload.

    A revisit has no payload of its own; see `resolve`.
    """
    arrow_batches(spark)
    rows = _parsed(spark, path)
    columns = ["record_id", "kind", "page_id", "url", "refers_to", "digest", "data"]
    return rows.where("segment is null").select(columns).unionByName(_reassembled(rows.where("segment is not null"))).withColumnRenamed("data", "payload")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Each page with the size and digest of its full payload; revisits have those of the response that they name."""
    whole = read(spark, path)
    made = F.when(F.col("kind") == "response", F.struct(F.octet_length("payload").cast("long").alias("bytes"), sha1_base32(F.col("payload")).alias("digest")))
    rows = stage(whole.select("page_id", "kind", "refers_to", "digest", made.alias("own")), "warc-pages")
    wrong = F.raise_error(F.concat(F.lit("payload digest of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?"))))
    right = rows.withColumn("own", F.when(F.col("kind") != "response", F.col("own")).when(F.col("own.digest") == F.col("digest"), F.col("own")).otherwise(wrong))
    named = right.where("kind = 'revisit'").alias("v")
    found = right.where("kind = 'response' and page_id is not null").groupBy(F.col("page_id").alias("response"), F.col("digest").alias("of")).agg(F.first("own").alias("seen"))
    found = stage(found, "warc-responses")
    resolved = named.join(found, (F.col("refers_to") == F.col("response")) & (F.col("digest") == F.col("of")), "left").select("page_id", F.col("seen").alias("own"), "kind", "refers_to")
    both = right.where("kind = 'response'").select("page_id", "own", "kind", "refers_to").unionByName(resolved)
    return both.select("page_id", F.col("own.bytes").alias("payload_bytes"), F.col("own.digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def roundtrip(pages: DataFrame) -> DataFrame:
    """Archives the pages and reads the archives back: the result of op3."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    return digests(spark, path)
