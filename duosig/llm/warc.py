"""WARC archives whose revisit records refer to the response with the same payload."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Bytes of payload in one archive file.
ARCHIVE_BYTES = 32 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of(sha: Column) -> Column:
    """Forty hexadecimal digits as 32 symbols of 5 bits: four groups of ten digits, each eight digits to the base of 32."""
    group = lambda k: F.lpad(F.conv(F.substring(sha, 10 * k + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[group(k) for k in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def resolve(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, refers_to_url, _sha.

    Of pages with equal payloads of at least min_bytes bytes, the one with the smallest page_id is the
    response and the others are revisits of it; smaller payloads are all responses. A null payload is
    empty. Rows that repeat the response's page_id and payload are responses too, as no record can refer
    to itself; a null page_id counts as the largest. Of such rows refers_to_url is the smallest url. Columns
    other than the three named aren't read.

    Only headers (digest, length, page_id, url) are aggregated; a digest that a third of the pages share has
    one row a task after the partial aggregation. The join of pages to originals is an inner equi-join
    on the digest, whose large partitions Spark splits. The digest is never null, so that no filter on it repeats its computation.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "_sha": F.sha1(F.col("payload").cast("binary"))})
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url"))
    headers = rows.groupBy("_sha", "payload_bytes").agg(first.alias("_first"))
    headers = headers.select(F.col("_sha").alias("_digest"), F.col("payload_bytes").alias("_bytes"), F.col("_first.page_id").alias("_page"), F.col("_first.url").alias("_url"))
    joined = rows.join(headers, (F.col("_sha") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")))
    response = (F.col("payload_bytes") < min_bytes) | F.col("_page").isNull() | F.col("page_id").eqNullSafe(F.col("_page"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", base32_of(F.col("_sha")).alias("payload_digest"),
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.when(~response, F.col("_page")).alias("refers_to"), F.when(~response, F.col("_url")).alias("refers_to_url"), "_sha",
    )


def record_id(page_id: str, url: str) -> Column:
    """A record's name from page_id, url and payload digest: rows alike in all three are the same record, each written."""
    made = F.sha1(F.concat_ws("\n", F.coalesce(F.col(page_id).cast("string"), F.lit("null")), F.coalesce(F.col(url), F.lit("")), "_sha").cast("binary"))
    cut = [F.substring(made, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def record(date: str) -> Column:
    """A row of resolve() as the text of a WARC record, up to the two line ends that close it."""
    crlf = "\r\n"
    revisit = F.col("record_type") == "revisit"
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    clean = lambda c: F.regexp_replace(F.col(c), r"[\x00-\x20\x7F]", "%20")
    line = lambda name, value: F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(crlf)), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}"), line("Content-Length", number("payload_bytes")), F.lit(crlf))
    refers = [
        line("WARC-Refers-To", record_id("refers_to", "refers_to_url")), line("WARC-Refers-To-Target-URI", clean("refers_to_url")),
        line("WARC-Refers-To-Date", F.lit(date)), line("WARC-Profile", F.lit(PROFILE)), line("X-Refers-To-Page-ID", number("refers_to")),
    ]
    head = [
        F.lit("WARC/1.1" + crlf), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", record_id("page_id", "url")), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("X-Page-ID", number("page_id")), line("X-Payload-Length", number("payload_bytes")), F.when(revisit, F.concat(*refers)).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))).cast("string")), F.lit(crlf), http,
    ]
    return F.concat(*head, F.when(revisit, "").otherwise(F.col("payload")))


def write_archives(resolved: DataFrame, path: str, sizes: DataFrame, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes gzipped archives of about archive_bytes of payload into a folder that executors share.

    Spark's text writer does it: the two line ends that close a WARC record are its line separator, and an
    archive is one gzip member. sizes has a column bytes for every record; a mean gives the records of an archive, and payloads of
    over an eighth of an archive go apart, a few to an archive. date (by default now, in UTC) goes into the fresh headers; it is fixed
    before tasks start, so that a repeated task writes the same bytes.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    large = archive_bytes // 8
    known = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.least("bytes", F.lit(large))), F.lit(0)).alias("b"), F.coalesce(F.max("bytes"), F.lit(0)).alias("top")).first()
    rows = max(1, archive_bytes * known["n"] // max(1, known["b"] + 600 * known["n"]))
    parts = [("small", F.col("payload_bytes") <= large, rows), ("large", F.col("payload_bytes") > large, 8)] if known["top"] > large else [("small", F.lit(True), rows)]
    for name, which, most in parts:
        writer = resolved.where(which).select(record(date).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
        writer.option("maxRecordsPerFile", most).text(f"{path}/{name}")


def parse(content: bytes) -> Iterator[dict]:
    """The records of an uncompressed archive: headers in lower case, and the payload after the HTTP header."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        stop = end + 4 + int(head["content-length"])
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"a record that ends at byte {stop} isn't closed")
        block = content[end + 4 : stop]
        yield head | {"payload": block[block.index(b"\r\n\r\n") + 4 :]}
        at = stop + 4


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import base64
    import hashlib
    import zlib

    number = lambda x: None if x in (None, "null") else int(x)
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for r in parse(zlib.decompress(content, 31)):
                kind, size, digest = r["warc-type"], int(r["x-payload-length"]), r["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response":
                    size, found = len(r["payload"]), base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
                    if found != digest:
                        raise ValueError(f"payload of {r['warc-record-id']} doesn't have its digest")
                rows.append((number(r["x-page-id"]), r.get("warc-target-uri"), r["payload"] if kind == "response" else None, size, digest, kind, number(r.get("x-refers-to-page-id"))))
            frame = pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path; a response's length and digest are taken from its payload and checked.

    A task reads whole files, whose size write_archives() bounds (one very long payload is one record).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.mapInPandas(_read, schema)


def revisit_archives(pages: DataFrame, min_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Writes pages as deduplicated archives into the shared folder and reads them back; see resolve()."""
    path = shared.new_path(pages.sparkSession)
    sizes = pages.select(F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"))
    with shared.dropping_shuffles(pages.sparkSession):
        write_archives(resolve(pages, min_bytes), path, sizes, date)
    return read_archives(pages.sparkSession, path)
