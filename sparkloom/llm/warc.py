"""WARC archives: writing, reading, and resolution of revisit records.

Records are written by Spark's own text writer, one record a line, with the
record terminator CRLF CRLF as the line separator, so archives go to any file
system through Spark's commit protocol. Reading takes whole archive files and
cuts records by Content-Length, never by searching for separators.

Defined cases: a null payload is the empty payload; a null target URI is
written as an empty header and read back as null, line breaks in one become
spaces; records with equal payloads revisit the record with the smallest id;
a null id is written as an empty header, sorts last and is read back as null;
repeated rows that bear the smallest id are all responses; an empty table gives
an archive folder without records. Only the named columns are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import read_table, shared_dir, travels, written

travels(__name__)

CRLF = "\r\n"
END = CRLF + CRLF

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed values of the hexadecimal-like digits that conv() gives in base 32, and of RFC 4648.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

HEADERS = "record_id string, record_type string, target_uri string, page_id long, payload_digest string, payload_bytes long, refers_to_id string, block_bytes long, archive string, offset long"
RECORDS = f"{HEADERS}, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes, without a label."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _record_id(kind: str, page_id: Column, digest: Column) -> Column:
    """A name-based urn:uuid of the record: the same record gets the same id in a rerun."""
    h = F.md5(F.concat_ws("|", F.lit(kind), page_id.cast("string"), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _clean(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c.cast("string"), r"[\r\n]+", " "), F.lit(""))


def roles(payloads: DataFrame) -> DataFrame:
    """(payload_digest, first_id, first_uri) of every payload that several records share.

    payloads: (page_id, url, payload_digest). A partial aggregation leaves one row
    per digest and task, so a hot payload is no hot key.
    """
    first = F.min(F.struct(F.col("page_id").isNull().alias("no"), "page_id", F.col("url").isNull().alias("none"), "url")).alias("first")
    several = payloads.groupBy("payload_digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
    return several.select("payload_digest", F.lit(True).alias("shared"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_uri"))


def to_records(pages: DataFrame, date: str) -> DataFrame:
    """One column ``value``: a record's headers and block, without its terminator.

    pages: (page_id, url, html, payload_digest, shared, first_id, first_uri).
    Responses carry the payload as their block; revisits have an empty block and
    name the response.
    """
    html = F.coalesce("html", F.lit(""))
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    size = F.octet_length(html).cast("string")

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    own = _record_id("response", F.col("page_id"), F.col("payload_digest"))
    common = [
        F.lit(VERSION + CRLF),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", F.when(revisit, _record_id("revisit", F.col("page_id"), F.col("payload_digest"))).otherwise(own)),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", _clean(F.col("url"))),
        header("WARC-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        header("WARC-Payload-Length", size),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
    ]
    link = F.concat(
        header("WARC-Profile", F.lit(PROFILE)),
        header("WARC-Refers-To", _record_id("response", F.col("first_id"), F.col("payload_digest"))),
        header("WARC-Refers-To-Target-URI", _clean(F.col("first_uri"))),
        header("WARC-Refers-To-Page-ID", F.coalesce(F.col("first_id").cast("string"), F.lit(""))),
    )
    tail = F.when(revisit, F.concat(link, header("Content-Length", F.lit("0")), F.lit(CRLF))).otherwise(F.concat(header("Content-Length", size), F.lit(CRLF), html))
    return pages.select(F.concat(*common, tail).alias("value"))


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 4096, file_mb: int = 64) -> str:
    """Write deduplicated archives of ``pages`` (page_id, url, html) to ``path``.

    Headers alone are shuffled by payload digest to find what is shared; payloads
    meet only those. A file, which a reader takes whole, has records_per_file records
    at most, and no more than make up file_mb at the payloads' mean size.
    """
    html = F.coalesce("html", F.lit(""))
    mean = pages.agg(F.avg(F.octet_length(html))).first()[0] or 0.0
    records_per_file = max(1, min(records_per_file, int((file_mb << 20) / (mean + 600))))
    pages = pages.select("page_id", "url", "html", base32_sha1(html).alias("payload_digest"))
    shared = written(roles(pages.drop("html")), "warc-roles")
    records = to_records(pages.join(shared, "payload_digest", "left"), date)
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    return path


def parse_records(stream: Iterator[bytes], archive: str) -> Iterator[dict]:
    """Records of one archive, given as pieces of its uncompressed bytes. Offsets count uncompressed bytes."""
    buffer, at, ended = bytearray(), 0, False

    def fill(until) -> bool:
        nonlocal ended
        while not ended and not until():
            piece = next(stream, None)
            ended = piece is None
            buffer.extend(piece or b"")
        return bool(until())

    while True:
        if not fill(lambda: len(buffer) > 0):
            return
        if not fill(lambda: buffer.find(b"\r\n\r\n") >= 0):
            raise ValueError(f"{archive}: a record's header at {at} has no end")
        end = buffer.find(b"\r\n\r\n")
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{archive}: no record at {at}")
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(named["content-length"])
        whole = end + 4 + size + 4
        if not fill(lambda whole=whole: len(buffer) >= whole) or buffer[whole - 4 : whole] != b"\r\n\r\n":
            raise ValueError(f"{archive}: the record at {at} is cut off")
        yield {"headers": named, "block": bytes(buffer[end + 4 : end + 4 + size]), "offset": at}
        del buffer[:whole]
        at += whole


def _unpacked(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The uncompressed bytes of one or several gzip members, in pieces; what is given is looked at once."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while at < len(view) and not member.eof:
            piece = view[at : at + step]
            at += len(piece)
            while len(piece) and not member.eof:
                yield member.decompress(piece, 4 * step)
                piece = member.unconsumed_tail
        at -= len(member.unused_data)


def _number(x: str | None) -> int | None:
    return int(x) if x else None


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Headers of all records under ``path``, with the payloads if asked for.

    payload_bytes and payload_digest of a response are worked out from the block
    that was read; a digest that differs from the header's raises.
    """
    import base64
    import hashlib

    names = [x.split()[0] for x in (RECORDS if payloads else HEADERS).split(", ")]

    def rows(archive: str, content: bytes) -> Iterator[dict]:
        for r in parse_records(_unpacked(content), archive):
            h, block = r["headers"], r["block"]
            kind, digest = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:")
            if kind == "response":
                own = base64.b32encode(hashlib.sha1(block).digest()).decode()
                if digest and own != digest:
                    raise ValueError(f"{archive}: the record at {r['offset']} doesn't have its digest")
                digest = own
            yield {
                "record_id": h["warc-record-id"], "record_type": kind, "target_uri": h.get("warc-target-uri") or None, "page_id": _number(h.get("warc-page-id")), "payload_digest": digest,
                "payload_bytes": len(block) if kind == "response" else _number(h.get("warc-payload-length")), "refers_to_id": h.get("warc-refers-to"), "block_bytes": len(block), "archive": archive, "offset": r["offset"],
                "payload": block if payloads and kind == "response" else None,
            }

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                for row in rows(archive.as_py(), content.as_buffer().to_pybytes()):
                    held.append({k: row[k] for k in names})
                    size += 200 + row["block_bytes"] * payloads
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in (RECORDS if payloads else HEADERS).split(", ")])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(parse, RECORDS if payloads else HEADERS)


def resolve_revisits(headers: DataFrame) -> DataFrame:
    """Every record's header with the response that it stands for.

    Headers are shuffled by payload digest and revisits joined to the response of
    the same digest (of several, that with the smallest page id), which gives
    refers_to and the payload's true length; a revisit without one keeps nulls.
    """
    first = F.min(F.struct(F.col("page_id").isNull().alias("no"), "page_id", "payload_bytes", "record_id")).alias("first")
    origin = headers.where("record_type = 'response'").groupBy("payload_digest").agg(first)
    origin = written(origin.select("payload_digest", F.col("first.page_id").alias("_page"), F.col("first.payload_bytes").alias("_bytes"), F.col("first.record_id").alias("_record")), "warc-origins")
    out = headers.join(origin, "payload_digest", "left")
    revisit = F.col("record_type") == "revisit"
    out = out.withColumn("refers_to", F.when(revisit, F.col("_page"))).withColumn("payload_bytes", F.when(revisit, F.col("_bytes")).otherwise(F.col("payload_bytes")))
    return out.withColumn("resolved", ~revisit | F.col("_record").isNotNull()).drop("_page", "_bytes", "_record")


def deduplicate_archive(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite the archives under ``source``, whose revisits may point anywhere, as deduplicated ones.

    Records whose payload is known (responses, and revisits with a response among
    them) are written with fresh headers; returned are the headers of the rest.
    """
    records = read_archive(spark, source, payloads=True)
    known = records.where("record_type = 'response'")
    bodies = known.groupBy("payload_digest").agg(F.min("payload").alias("html")).withColumn("html", F.col("html").cast("string"))  # the same bytes, whatever their charset
    whole = records.select("page_id", F.col("target_uri").alias("url"), "payload_digest").join(bodies, "payload_digest")
    write_archive(whole, target)
    return records.drop("payload").join(bodies.select("payload_digest"), "payload_digest", "left_anti")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = write_archive(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    headers = written(read_archive(spark, path), "warc-headers")
    return resolve_revisits(headers).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("target_uri").alias("url"))


SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, url, html, sha1(html) AS x, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, 1 + 10 * (i // 8), 10))::BIGINT) >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), '') AS payload_digest,
CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM h
"""
