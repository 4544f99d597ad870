"""WARC archives with resolved revisits.

Only headers (page id, payload digest, length) are shuffled by digest to find each payload's original, the
record with the smallest id; then bodies meet their decisions by id, and a page whose payload another one
holds is written as a revisit record without a body. A response's block is an HTTP response whose body is the payload.
The archives are written by Spark's text sink, one row per record with CRLF CRLF as the separator, gzipped by file, into
the folder that the cluster shares. They are read back as a stream of the pieces between such separators, which
Content-Length puts together again whatever the payloads hold, so that a task holds one record and not a file.

Null html counts as an empty payload, a null url as an empty target; an empty table gives no archive. A page
with a null id has no X-Page-ID field and sorts last. Rows that repeat an id and its payload get the same record type; only
rows that agree in id, payload and url share a record id. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import own_dir, stored

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
#: Records of an archive file at most, as a gzipped file is read by one task. Parts that the pages of one payload are split into.
FILE_RECORDS, SALT = 4_000, 16


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four times 40 bits as 8 digits."""
    hexes = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexes, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolved(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload (binary; null for revisits), payload_bytes, payload_digest, refers_to, refers_to_uri.

    least: payloads of fewer bytes are never revisits.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.select("*", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    headers = rows.select("page_id", "url", "payload_bytes", "payload_digest")
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")
    first = (
        headers.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min(order).alias("first"), F.count("*").alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    # the pages of a payload that many share meet its first page in SALT places
    salted = headers.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    others = (
        salted.join(first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["payload_digest", "payload_bytes", "salt"])
        .where(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
        .select(F.col("page_id").alias("id_"), F.col("payload_digest").alias("digest_"), F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_to_uri"))
        .dropDuplicates(["id_", "digest_"])
    )
    met = rows.join(others, F.col("page_id").eqNullSafe(F.col("id_")) & (F.col("payload_digest") == F.col("digest_")), "left")
    return met.select(
        "page_id",
        "url",
        F.when(F.col("digest_").isNull(), F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.col("digest_").isNotNull().alias("revisit"),
        "refers_to",
        "refers_to_uri",
    )


def _record_id(page: Column, digest: Column, url: Column) -> Column:
    """A name-based UUID of page id, payload and url."""
    h = F.sha1(F.concat_ws("\n", F.lit("vellum:page"), F.coalesce(F.concat(F.lit("="), page.cast("string")), F.lit("-")), digest, url).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write(rows: DataFrame, path: str, date: str | None = None) -> None:
    """Writes the rows of resolved() as archives of at most FILE_RECORDS records, dated now unless a date is given.

    Line breaks in an url would end its header line; they are percent-encoded. Page ids are form-encoded.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    uri = lambda c: F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    page = lambda name, c: F.coalesce(line(name, F.url_encode(F.col(c).cast("string"))), F.lit(""))
    revisit, digest = F.col("revisit"), F.col("payload_digest")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2)
    )
    length = F.length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"), digest, F.col("url"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        page("X-Page-ID", "page_id"),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit(REVISIT_PROFILE)),
                line("WARC-Refers-To", _record_id(F.col("refers_to"), digest, F.col("refers_to_uri"))),
                line("WARC-Refers-To-Target-URI", uri(F.col("refers_to_uri"))),
                line("WARC-Refers-To-Date", F.lit(date)),
                page("X-Refers-To-Page-ID", "refers_to"),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit(HTTP_TYPE)),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
    )
    record = F.concat(head.cast("binary"), F.coalesce(F.col("payload"), F.lit("").cast("binary"))).cast("string")
    rows.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


class Parser:
    """Records of archives that come in pieces. A record's two line breaks at the end and any more before the next are skipped."""

    def __init__(self):
        self.held: list[bytes] = []
        self.size, self.want, self.fields = 0, 0, None

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """Header fields (names in lower case) and block of each record that the piece completes."""
        self.held.append(piece)
        self.size += len(piece)
        while self.size >= self.want:
            data = b"".join(self.held)
            if self.fields is None:
                data = data.lstrip(b"\r\n")
                end = data.find(b"\r\n\r\n")
                if end < 0:
                    self.held, self.size, self.want = [data], len(data), len(data) + 1
                    return
                self.fields = {}
                for text in data[:end].decode().split(CRLF)[1:]:
                    name, _, value = text.partition(":")
                    self.fields[name.lower()] = value.strip()
                data = data[end + 4 :]
                self.want = int(self.fields["content-length"])
            else:
                fields, block, data = self.fields, data[: self.want], data[self.want :]
                self.fields, self.want = None, 1
                yield fields, block
            self.held, self.size = [data], len(data)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    return Parser().feed(archive)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id (string), record_type, payload_bytes, payload_digest, refers_to (string), url: one row per record of the archives.

    A response's size and digest are taken from its block after the HTTP head; a revisit's from its heads.
    """
    schema = "page_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, url string"
    types = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in schema.split(", ")])

    def row(f: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        size, digest = len(payload), f["warc-payload-digest"].partition(":")[2]
        if f["warc-type"] == "revisit":
            size = int(next(x for x in http.decode().lower().split(CRLF) if x.startswith("content-length:")).partition(":")[2])
        else:
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        name = lambda key: unquote_plus(f[key]) if key in f else None
        return name("x-page-id"), f["warc-type"], size, digest, name("x-refers-to-page-id"), f["warc-target-uri"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for b in batches:
            rows = [row(f, block) for piece in b.column(0) for f, block in parser.feed(piece.as_py() + b"\r\n\r\n")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)

    # a gzipped file is never split, and its pieces come in order
    pieces = spark.read.option("lineSep", CRLF * 2).text(path).select(F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(run, schema)


def archive(pages: DataFrame, path: str | None = None, least: int = 0, id_col: str = "page_id", **columns) -> DataFrame:
    """Writes the pages as archives, reads these back and resolves the revisits against the responses read.

    page_id, payload_bytes, payload_digest, record_type, refers_to for each row; a revisit whose response was not read
    back has no payload_bytes and no digest.
    """
    spark = pages.sparkSession
    path = path or f"{own_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(resolved(pages, least, id_col, **columns), path)
    id_type = pages.schema[id_col].dataType
    back = stored(read(spark, path), "warc-records")
    responses, revisits = back.where("record_type = 'response'"), back.where("record_type = 'revisit'")
    # distinct pairs are checked, so that a payload that many revisit is no hot key; pairs without their response are expected to be none
    named = revisits.select(F.col("refers_to").alias("to"), F.col("payload_digest").alias("digest_")).distinct()
    lost = stored(named.join(responses.select(F.col("page_id").alias("to"), F.col("payload_digest").alias("digest_")), ["to", "digest_"], "left_anti"), "warc-lost")
    met = revisits.join(lost, (F.col("refers_to") == F.col("to")) & (F.col("payload_digest") == F.col("digest_")), "left")
    of_response = lambda c: F.when(F.col("to").isNull(), F.col(c)).alias(c)
    columns_ = [F.col("page_id").cast(id_type).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to")]
    met = met.select("page_id", of_response("payload_bytes"), of_response("payload_digest"), "record_type", "refers_to").select(*columns_)
    return responses.select(*columns_).unionByName(met)
