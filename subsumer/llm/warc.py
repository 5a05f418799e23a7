"""WARC archives: records written by Spark, segments put together again on reading.

A response's block is an HTTP message in chunked transfer framing. Blocks longer than a segment are cut: the
first segment stays a `response` record, the others are `continuation` records with the origin's id, their
number and, on the last, the total length. Records whose payload another record has already are `revisit`
records that name it and have no body.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, small_join, table

#: Bytes of the blocks in a file before compression, at most: a file's records are counted by the largest segment.
FILE_BYTES = 128 << 20
CRLF = "\r\n"
#: The digits of base 32 as Spark's conv() writes them, and as RFC 4648 does.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PARSED = (
    "record_id string, origin string, record_type string, page_id long, uri string, refers_to_id string, stated_digest string, "
    "segment int, total_bytes long, block binary, payload binary, payload_bytes long, payload_digest string"
)
JOINED = "record_id string, record_type string, page_id long, uri string, refers_to_id string, stated_digest string, payload binary, payload_bytes long, payload_digest string"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1: 20 bits, five hex digits, become four digits at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _raw(binary: Column) -> Column:
    """The bytes as a string that Spark neither checks nor changes."""
    return binary.cast("string")


def _chunked(payload: Column, chunk_bytes: int) -> Column:
    size = F.octet_length(payload)
    starts = F.when(size > 0, F.sequence(F.lit(1), size, F.lit(chunk_bytes))).otherwise(F.array().cast("array<int>"))

    def framed(at: Column) -> Column:
        part = F.substring(payload, at, F.lit(chunk_bytes))
        return F.concat(F.hex(F.octet_length(part)), F.lit(CRLF), _raw(part), F.lit(CRLF))

    return F.concat(F.array_join(F.transform(starts, framed), ""), F.lit("0" + CRLF + CRLF))


def write_archives(rows: DataFrame, path: str, *, chunk_bytes: int = 4096, segment_bytes: int = 16384, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record for each row of (page_id, url, payload) as gzipped WARC files under path.

    payload: binary; null is empty. Rows with equal payloads: the row with the smallest page_id (null last; then
    by url) becomes the response, the others revisit it. Repeated rows with the same page_id, url and payload are
    the same record written again. Other columns are ignored; an empty table gives no records. Payloads of any length
    that one row can hold are cut into segments; a file holds FILE_BYTES of blocks at most, or one record. Which record
    comes first is found on ids and digests alone, so payloads that many rows share do not meet in one task. The text
    source writes the files: its line separator is the end of a WARC record, and its commits keep failed attempts out.
    """
    payload = F.coalesce(F.col("payload"), F.lit(b""))
    page, url = F.col("page_id").cast("string"), F.coalesce(F.col("url").cast("string"), F.lit(""))
    source = rows.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"), base32_sha1(payload).alias("digest"))
    identity = F.md5(F.concat_ws("|", F.coalesce(page, F.lit("-")), F.col("url"), F.col("digest")).cast("binary"))
    uid = F.regexp_replace(identity, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    source = source.withColumn("record_id", uid)
    ids = table(source.select("record_id", "digest", "page_id", "url").distinct(), "warc-ids")
    # one small row for each distinct payload, summed up before the shuffle
    first = ids.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "record_id")).alias("first"))
    both = source.join(small_join(ids.select("record_id", "digest"), first, ["digest"]).select("record_id", "first"), "record_id")
    is_first = F.col("record_id") == F.col("first.record_id")

    http = F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF)
    whole = F.concat(http, F.lit("Transfer-Encoding: chunked" + CRLF + CRLF), _chunked(F.col("payload"), chunk_bytes))
    bare = F.concat(http, F.lit(CRLF))
    block = F.when(is_first, whole).otherwise(bare).cast("binary")
    both = both.select("record_id", "page_id", "url", "digest", "first", is_first.alias("is_first"), block.alias("block"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("block") / segment_bytes)).cast("int")

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value, F.lit(CRLF))

    def record(i: Column) -> Column:
        part = F.substring(F.col("block"), (i - 1) * segment_bytes + 1, F.lit(segment_bytes))
        kind = F.when(i > 1, "continuation").when(F.col("is_first"), "response").otherwise("revisit")
        own_id = F.when(i > 1, F.concat(F.substring("record_id", 1, 46), F.lit("-"), i.cast("string"), F.lit(">"))).otherwise(F.col("record_id"))
        head = [
            F.lit("WARC/1.1" + CRLF),
            field("WARC-Type", kind),
            field("WARC-Record-ID", own_id),
            field("WARC-Date", F.lit(date)),
            field("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", " ")),
            field("Content-Type", F.lit("application/http;msgtype=response")),
            field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.when(F.col("page_id").isNotNull(), field("X-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
            F.when(kind == "revisit", F.concat(field("WARC-Refers-To", F.col("first.record_id")), field("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
            F.when(n > 1, field("WARC-Segment-Number", i.cast("string"))).otherwise(""),
            F.when(i > 1, field("WARC-Segment-Origin-ID", F.col("record_id"))).otherwise(""),
            F.when((i > 1) & (i == n), field("WARC-Segment-Total-Length", F.octet_length("block").cast("string"))).otherwise(""),
            field("Content-Length", F.octet_length(part).cast("string")),
            F.lit(CRLF),
            _raw(part),
        ]
        return F.concat(*head)

    records = both.select(F.explode(F.transform(F.sequence(F.lit(1), n), record)).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", max(1, FILE_BYTES // segment_bytes)).text(path)


def records_in(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a WARC file."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head.get("content-length", 0))
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"record {head.get('warc-record-id')} ends after {len(block)} of {size} bytes")
        yield head, block


def unchunk(body: bytes) -> bytes:
    """The payload in a body with chunked transfer framing (RFC 9112, 7.1)."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        at = end + 4 + size


def payload_in(block: bytes) -> bytes:
    """The payload of an HTTP message, out of its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _parsed(head: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind, record_id = head["warc-type"], head["warc-record-id"]
    stated = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    segment = int(head.get("warc-segment-number", 0))
    page = int(head["x-page-id"]) if "x-page-id" in head else None
    total = int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None
    origin = head.get("warc-segment-origin-id", record_id)
    common = (record_id, origin, kind, page, head.get("warc-target-uri"), head.get("warc-refers-to"), stated)
    if kind == "revisit":
        return (*common, 1, None, None, None, None, None)
    if segment:
        return (*common, segment, total, block, None, None, None)
    payload = payload_in(block)
    return (*common, 1, None, None, payload if payloads else None, len(payload), _checked(payload, stated, record_id))


def _checked(payload: bytes, stated: str | None, record_id: str) -> str:
    found = sha1_base32(payload)
    if stated and stated != found:
        raise ValueError(f"record {record_id}: the payload's digest is {found}, its header says {stated}")
    return found


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """A row for each response and revisit record under path, segments put together and transfer framing removed.

    payloads=False leaves the payload null, so that it isn't shuffled; its size and digest stay. A record whose
    segments aren't numbered 1, 2, ... n, whose total length or digest differs from its header, or that is cut
    off, raises. Copies of a record (same id) come back as often as they were written.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PARSED.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                stream = io.BytesIO(content)
                opened = gzip.GzipFile(fileobj=stream) if content[:2] == b"\x1f\x8b" else stream
                rows, held = [], 0
                for head, block in records_in(opened):
                    if head.get("warc-type") not in ("response", "revisit", "continuation"):
                        continue
                    rows.append(_parsed(head, block, payloads))
                    held += len(block)
                    if held > 1 << 24 or len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "total_bytes": "Int64", "payload_bytes": "Int64"})
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "total_bytes": "Int64", "payload_bytes": "Int64"})

    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = files.mapInPandas(parse, PARSED)
    head = F.col("record_type") != "continuation"
    first = lambda c: F.max(F.when(head, F.col(c))).alias(c)
    grouped = parsed.groupBy("origin").agg(
        *map(first, ("record_type", "page_id", "uri", "refers_to_id", "stated_digest", "payload", "payload_bytes", "payload_digest")),
        F.count_if(head).alias("copies"),
        F.max("total_bytes").alias("total_bytes"),
        # a set: copies of a segment meet before the shuffle
        F.collect_set(F.when(F.col("block").isNotNull(), F.struct("segment", "block"))).alias("parts"),
    )

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, parts in zip(batch.index, batch["parts"], strict=True):
                if not len(parts):
                    continue
                parts = sorted(parts, key=lambda p: p["segment"])
                origin, total = batch.at[i, "origin"], batch.at[i, "total_bytes"]
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                    raise ValueError(f"record {origin}: segments are missing or differ")
                block = b"".join(bytes(p["block"]) for p in parts)
                if pd.isna(total) or len(block) != int(total):
                    raise ValueError(f"record {origin}: {len(block)} bytes, but the last segment says {total}")
                payload = payload_in(block)
                batch.at[i, "payload"] = payload if payloads else None
                batch.at[i, "payload_bytes"] = len(payload)
                batch.at[i, "payload_digest"] = _checked(payload, batch.at[i, "stated_digest"], origin)
            batch = batch.rename(columns={"origin": "record_id"})
            yield batch.loc[batch.index.repeat(batch["copies"]), [x.split()[0] for x in JOINED.split(", ")]].astype({"page_id": "Int64", "payload_bytes": "Int64"})

    return grouped.mapInPandas(put_together, JOINED)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records with refers_to (page_id of the response that a revisit names), and the size and digest of that payload."""
    named = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("their_bytes"), F.col("payload_digest").alias("their_digest")
    ).dropDuplicates(["refers_to_id"])
    # records that name none get a key of their own: nulls would all meet in one task
    named = named.withColumnRenamed("refers_to_id", "_their_id")
    key = F.coalesce("refers_to_id", F.concat(F.lit("-"), "record_id"))
    return records.withColumn("_their_id", key).join(named, "_their_id", "left").select(
        "page_id",
        F.coalesce("payload_bytes", "their_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "their_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
