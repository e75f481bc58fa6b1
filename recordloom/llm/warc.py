"""WARC archives of web pages with revisit records for payloads that were seen before.

Only headers are shuffled by payload digest: one row per digest decides which page keeps the
payload.  The decisions on repeated payloads, a digest and an id each, are broadcast to the
pages while their measured size allows, so no payload moves; beyond that size they meet by a
shuffle.  Archives are written by Spark's text writer, one record a row, with the record
terminator as its line separator; so files are committed as one and a lost executor's
attempts leave nothing behind.  Files are gzip streams of at most `RECORDS_PER_FILE` records.
Reading them back parses records by Content-Length, and revisits are resolved by joining
their WARC-Refers-To with the records' ids.

Defined cases: a null payload is an empty one; of rows equal in page_id and payload every one
that holds the largest page_id is a response; a null page_id ranks below all others; a null
url leaves WARC-Target-URI out; control characters in a url are percent-encoded.  An empty
table gives an empty archive.  Extra columns are ignored.
"""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.shuffle import broadcast_if_small
from ..session import fresh_path
from .common import by_batch, column, read, saved

LEAST_BYTES = 1000
RECORDS_PER_FILE = 4096
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def pages_of(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, size) of a page table."""
    body = F.coalesce(column(pages, "html", "string"), F.lit(""))
    return pages.select(column(pages, "page_id", "long").alias("page_id"), column(pages, "url", "string").alias("url"),
                        body.alias("payload"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size"))


def record_id(page_id: Column, digest: Column) -> Column:
    hexes = F.md5(F.concat_ws("/", page_id.cast("string"), digest))
    cuts = [F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def decided(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Pages with `keeper`: the page_id of the response that a revisit refers to, else null."""
    headers = pages.select("digest", "size", "page_id").filter(F.col("size") >= least)
    groups = (headers.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last"))
              .filter((F.col("n") > 1) & F.col("last").isNotNull()).select("digest", "last"))
    groups = saved(groups, "keepers")
    out = pages.join(broadcast_if_small(groups, row_bytes=96), "digest", "left")
    other = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return out.withColumn("keeper", F.when(other, F.col("last"))).drop("last")


def record_text(page: DataFrame, written: dt.datetime | None = None) -> DataFrame:
    """One WARC record per row, without its closing blank lines, in column `value`; dated by the time of writing."""
    date = (written or dt.datetime.now(dt.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    again = F.col("keeper").isNotNull()
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), " ", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                    F.col("size").cast("string"), F.lit(END * 2))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.0{END}"), field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        field("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))), field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", url), field("X-Page-Id", F.col("page_id").cast("string")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Profile", F.when(again, PROFILE)),
        field("WARC-Refers-To", F.when(again, record_id(F.col("keeper"), F.col("digest")))),
        field("Content-Type", F.lit("application/http;msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")), F.lit(END))
    return page.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of decided pages; a file holds a bounded number of records."""
    (record_text(pages).write.option("lineSep", END * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and block of every record of an unpacked archive."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode("utf-8", "replace").split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start = end + 4
        stop = start + int(fields["content-length"])
        yield fields, archive[start:stop]
        if archive[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end at {stop}")
        at = stop + 4


RECORD = ("record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
          "refers_to_record string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records below `path`, sizes and digests taken from the payload bytes as read."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for packed in batch.column("content"):
            rows = []
            for fields, block in parse(gzip.decompress(packed.as_py())):
                payload = None if fields["warc-type"] == "revisit" else block[block.index(b"\r\n\r\n") + 4:]
                page = fields.get("x-page-id")
                rows.append((fields["warc-record-id"], None if page is None else int(page), fields.get("warc-target-uri"),
                             fields["warc-type"], None if payload is None else len(payload),
                             None if payload is None else hashlib.sha1(payload).hexdigest(), fields.get("warc-refers-to")))
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            names = [f.split()[0] for f in RECORD.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return by_batch(files, work, RECORD, "content", 1)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload size and digest, and the page, of what revisits refer to."""
    answers = (records.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record"))
               .agg(F.first("page_id").alias("to_page"), F.first("payload_bytes").alias("to_bytes"),
                    F.first("payload_digest").alias("to_digest")))
    again = records.filter("record_type = 'revisit'").join(answers, "refers_to_record", "left")
    plain = records.filter("record_type = 'response'")
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    first = plain.withColumn("refers_to", F.lit(None).cast("long")).select(*names)
    return first.unionByName(again.select(
        "page_id", "url", F.col("to_bytes").alias("payload_bytes"), F.col("to_digest").alias("payload_digest"),
        "record_type", F.col("to_page").alias("refers_to")))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives with revisits, then read back and resolved."""
    path = fresh_path(spark, "warc")
    write_archives(decided(pages_of(read(spark, sf_dir, "pages"))), path)
    return resolved(read_archives(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM k"""
