"""Operator 2: WARC archives with revisit resolution. Headers are shuffled by payload digest, revisit records joined to
the original responses, and deduplicated archives written with fresh headers."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import cut, shared_dir

CRLF = "\r\n"
#: Fixed values of WARC 1.1: what ends a record, and the profile of a revisit of an identical payload.
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ZONES = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8: four groups of 40 bits, each eight digits."""
    h = F.sha1(data)
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0"), *ZONES) for i in range(4)])


def urn(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("null")), F.lit("/"), digest))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def resolve_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, bytes, refers_to) once for each page_id and payload: refers_to is the largest page_id with
    the same payload, null for that one itself and for payloads under min_bytes.

    Only headers are shuffled, and for a digest that many pages share a map-side maximum is. Null page_ids come before
    all others; rows that repeat a page_id and payload are one record said again, and all are what the first is.
    """
    payload = F.coalesce("html", F.lit(""))
    headers = cut(pages.select("page_id", base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes")).distinct())
    many = headers.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisit = (F.col("bytes") >= min_bytes) & F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return headers.join(many, "digest", "left").select("page_id", "digest", "bytes", F.when(revisit, F.col("original")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a WARC 1.1 record for each row of ``pages`` (page_id, url, html) to gzipped files below ``path``.

    Responses hold an HTTP head and the payload, revisits the head alone with the identity of their original. The page's
    number rides in the extension field WARC-Source-Row. ``RECORD_END`` is the text writer's line end, so each row is
    one record; Content-Length counts bytes. Null html is an empty payload; a null url leaves out WARC-Target-URI, and
    blanks or control characters in one are percent-encoded. An empty table writes no records.
    """
    resolved = resolve_revisits(pages, min_bytes)
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("html"), base32_sha1(payload).alias("digest"))
    r = resolved.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "bytes", "refers_to")
    rows = keyed.join(r, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    is_revisit = F.col("refers_to").isNotNull()
    block = F.concat(head, F.when(is_revisit, F.lit("")).otherwise(F.col("html")))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    uri = F.col("url")
    for c in (9, 10, 13, 32):
        uri = F.replace(uri, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    uri = F.regexp_replace(uri, r"[\x00-\x1F\x7F]", "%EF%BF%BD")
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        field("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", F.concat(F.lit("<"), urn(F.col("page_id"), F.col("digest")), F.lit(">"))),
        field("WARC-Date", F.lit(date)),
        F.coalesce(field("WARC-Target-URI", uri), F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.coalesce(field("WARC-Source-Row", F.col("page_id").cast("string")), F.lit("")),
        F.when(is_revisit, F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", F.concat(F.lit("<"), urn(F.col("refers_to"), F.col("digest")), F.lit(">"))))).otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def header_fields(lines: list[str]) -> dict[str, str]:
    """Values by lower-case name. Blanks around a value are none of it; a line that begins with a blank goes on with the
    value before it."""
    fields: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t"):
            if name is None:
                raise ValueError("a header begins with a folded line")
            fields[name] = f"{fields[name]} {line.strip()}".strip()
        elif line:
            name, colon, value = line.partition(":")
            name = name.strip().lower()
            if not colon or not name:
                raise ValueError(f"no header field: {line!r}")
            fields[name] = value.strip()
    return fields


def records(read) -> object:
    """(fields, block) of each record of an uncompressed stream; ``read(n)`` gives n bytes, fewer at the end only."""
    rest = b""

    def fill(n):
        nonlocal rest
        while len(rest) < n:
            more = read(1 << 20)
            if not more:
                return False
            rest += more
        return True

    while fill(1):
        while (end := rest.find(b"\r\n\r\n")) < 0:
            if not fill(len(rest) + 1):
                raise ValueError("a record's header has no end")
        lines = rest[:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = header_fields(lines[1:])
        rest = rest[end + 4 :]
        size = int(fields["content-length"])
        if not fill(size + 4) or rest[size : size + 4] != b"\r\n\r\n":
            raise ValueError("a record's block is cut short")
        yield fields, rest[:size]
        rest = rest[size + 4 :]


RECORDS = "page_id long, record_id string, record_type string, refers_to_id string, payload_digest string, payload_bytes long, target_uri string, payload string"


def archive_reader(with_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("target_uri", pa.string()), ("payload", pa.string())])

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                data, unzip, at = memoryview(content.as_buffer()), zlib.decompressobj(31), 0

                def read(n):
                    nonlocal at, unzip
                    while True:
                        if unzip.eof:  # a file may be several gzip members, such as one for each record
                            at -= len(unzip.unused_data)
                            unzip = zlib.decompressobj(31)
                            if at == len(data):
                                return b""
                        if at == len(data):
                            if not at:
                                return b""
                            raise ValueError("an archive ends within a gzip member")
                        part = data[at : at + 65536]
                        at += len(part)
                        if out := unzip.decompress(part):
                            return out

                rows = []
                for fields, block in records(read):
                    payload = block.partition(b"\r\n\r\n")[2]
                    full = fields["warc-type"] == "response"
                    source = fields.get("warc-source-row")
                    rows.append({"page_id": None if source is None else int(source), "record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "refers_to_id": fields.get("warc-refers-to"), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if full else None, "payload_bytes": len(payload) if full else None, "target_uri": fields.get("warc-target-uri"), "payload": payload.decode() if full and with_payload else None})
                    if len(rows) >= 2000 or with_payload and len(rows) >= 100:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_archives(spark, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives below ``path``, digests and sizes taken from the payloads as they were read; what
    revisits have is filled in from their originals. Files come through Spark's reader, so any store will do; a task
    holds one packed file and unpacks it, all its gzip members, as a stream. A file that is cut short is an error."""
    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(archive_reader(with_payload), RECORDS)
    raw = raw if with_payload else cut(raw.drop("payload"))
    extra = ["payload"] if with_payload else []
    names = {"page_id": "original_page", "payload_digest": "d", "payload_bytes": "b", **({"payload": "x"} if with_payload else {})}
    originals = raw.where("record_type = 'response'").dropDuplicates(["record_id"]).select(F.col("record_id").alias("refers_to_id"), *[F.col(k).alias(v) for k, v in names.items()])
    # responses refer to nothing and stay out of the join, where they would be one key
    revisits = raw.where("record_type = 'revisit'").join(originals, "refers_to_id", "left")
    out = raw.where("record_type = 'response'").unionByName(revisits, allowMissingColumns=True)
    return out.select("page_id", "record_type", F.coalesce("payload_bytes", "b").alias("payload_bytes"), F.coalesce("payload_digest", "d").alias("payload_digest"), F.col("original_page").alias("refers_to"), "target_uri", *[F.coalesce(c, "x").alias(c) for c in extra])


# --------------------------------------------------------------------------- query


def op2_warc(spark, sf_dir):
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS o FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 1 + 10 * CAST(i // 8 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> o THEN o END AS refers_to
FROM g
"""
