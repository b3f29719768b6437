"""WARC archives of pages, and their assembly into captures.

Every page becomes a transaction of three records: a request, a response (or a
revisit, if another page has the same payload) and metadata.  Request and
metadata name the record they belong to in ``WARC-Concurrent-To``.  Archives are
written by Spark's text writer, so a task that is lost or runs twice leaves no
half-written file, and are read back as binary files of bounded size and parsed
by their ``Content-Length``.  Assembly joins the three kinds of records on the
concurrent-to identifier and emits one nested row per capture.

Of pages with equal payloads the one with the smallest id is the response; the
others are revisits that name it and carry its digest but no payload.  A digest
that a third of all pages share is met in parts.

Edge cases: a null page has an empty payload, which is a payload like any other;
a page without id revisits one with an id, and is a response where no equal page
has one; rows that repeat the id and payload of a response are responses too; a
null URL is left out; white space and control characters of a URL become ``%20``;
an empty table writes an archive without records.  Columns other than ``page_id,
url, html`` are not read and cannot clash.
"""

from __future__ import annotations

import gzip
import hashlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runweave.llm.common import attach_by_key
from runweave.storage import cut_lineage, shared_path

# Bytes of html that a file should hold about.
FILE_BYTES = 8 << 20
# Tasks that write; beyond them each writes several files.
MAX_TASKS = 65_536
# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"
GAP = EOL + EOL
STAMP = "2020-01-01T00:00:00Z"
HEX_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = (
    "kind string, record_id string, concurrent_to string, target string, digest string, "
    "n_bytes long, page_id long, refers_to long, payload string"
)


def base32_sha1(payload: Column) -> Column:
    """The bare base32 SHA-1 of a text: five hex digits are four base32 digits."""
    hex_digits = F.sha1(F.encode(payload, "UTF-8"))
    parts = [F.lpad(F.conv(F.substring(hex_digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), HEX_DIGITS, BASE32_DIGITS)


def _key() -> Column:
    return F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest")


def revisits(pages: DataFrame) -> tuple[DataFrame, int, int]:
    """``_key, first_id`` of the pages that revisit another, the number of pages and
    all bytes of html."""
    html = F.coalesce("html", F.lit(""))
    facts = pages.select(F.col("page_id").cast("long"), base32_sha1(html).alias("digest"), F.octet_length(html).alias("n"))
    facts = cut_lineage(facts.withColumn("spread", F.monotonically_increasing_id()), "payloads")
    firsts = facts.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    firsts = cut_lineage(firsts.where("rows > 1").drop("rows"), "firsts")
    n_pages, total = facts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0))).first()
    met = attach_by_key(facts, firsts, "digest", "spread").where("first_id is not null and not (page_id <=> first_id)")
    return met.select(_key().alias("_key"), "first_id").distinct(), n_pages, total


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the blank lines that end it."""
    size = F.octet_length(block).cast("string")
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in [*fields, ("Content-Length", size)]]
    return F.concat(F.concat_ws(EOL, F.lit(VERSION), *lines), F.lit(GAP), block)


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the archives of ``pages``; the records of a page are in one file.

    A file is cut at four times the pages that ``FILE_BYTES`` hold on average, so
    that neither the bound on tasks nor equal pages without an id, which meet in
    one task, make files grow.
    """
    seen, n_pages, total = revisits(pages)
    file_pages = max(1, 4 * n_pages * FILE_BYTES // max(1, total))
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("_key", _key())
    rows = rows.repartition(min(MAX_TASKS, max(1, -(-total // FILE_BYTES))), "_key").join(seen, "_key", "left")
    for kind in ("request", "answer", "metadata"):
        rows = rows.withColumn(kind, F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")))
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    again = F.col("first_id").isNotNull()
    common = [("WARC-Date", F.lit(STAMP)), ("WARC-Target-URI", target)]
    request = _record(
        [
            ("WARC-Type", F.lit("request")),
            ("WARC-Record-ID", F.col("request")),
            ("WARC-Concurrent-To", F.col("answer")),
            *common,
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(" HTTP/1.1" + GAP)),
    )
    head = F.concat(
        F.lit("HTTP/1.1 200 OK" + EOL + "Content-Type: text/html; charset=utf-8" + EOL + "Content-Length: "),
        F.octet_length("html").cast("string"),
        F.lit(GAP),
    )
    answer = _record(
        [
            ("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", F.col("answer")),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(again, F.lit(PROFILE))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(head, F.when(again, F.lit("")).otherwise(F.col("html"))),
    )
    metadata = _record(
        [
            ("WARC-Type", F.lit("metadata")),
            ("WARC-Record-ID", F.col("metadata")),
            ("WARC-Concurrent-To", F.col("answer")),
            *common,
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.concat_ws(
            EOL,
            F.concat(F.lit("page-id: "), F.col("page_id").cast("string")),
            F.concat(F.lit("refers-to-page-id: "), F.col("first_id").cast("string")),
        ),
    )
    archive = rows.select(F.concat_ws(GAP, request, answer, metadata).alias("value"))
    archive.write.option("maxRecordsPerFile", file_pages).text(path, compression="gzip", lineSep=GAP)


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record."""
    at = 0
    while at < len(raw):
        end = raw.index(GAP.encode(), at)
        first, *lines = raw[at:end].decode().split(EOL)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {name.lower(): value for name, _, value in (x.partition(": ") for x in lines)}
        start = end + len(GAP)
        stop = start + int(fields["content-length"])
        yield fields, raw[start:stop]
        at = stop + len(GAP)


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record.  Digests of responses are computed anew and compared;
    without ``payloads`` the bodies stay behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(c, pa.string()) for c in ("kind", "record_id", "concurrent_to", "target", "digest")]
            + [(c, pa.int64()) for c in ("n_bytes", "page_id", "refers_to")]
            + [("payload", pa.string())]
        )
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in parse_records(gzip.decompress(content.as_buffer())):
                    kind = fields["warc-type"]
                    row = {
                        "kind": kind,
                        "record_id": fields["warc-record-id"],
                        "concurrent_to": fields.get("warc-concurrent-to"),
                        "target": fields.get("warc-target-uri"),
                    }
                    if kind in ("response", "revisit"):
                        head, _, body = block.partition(GAP.encode())
                        http = {n.lower(): v for n, _, v in (x.partition(": ") for x in head.decode().split(EOL)[1:])}
                        row["digest"] = fields["warc-payload-digest"].removeprefix("sha1:")
                        row["n_bytes"] = int(http["content-length"])
                        if kind == "response":
                            if b32encode(hashlib.sha1(body).digest()).decode() != row["digest"] or len(body) != row["n_bytes"]:
                                raise ValueError(f"{row['record_id']}: payload does not fit its digest")
                            row["payload"] = body.decode() if payloads else None
                    elif kind == "metadata":
                        own = dict(x.partition(": ")[::2] for x in block.decode().split(EOL) if x)
                        row["page_id"] = _number(own.get("page-id"))
                        row["refers_to"] = _number(own.get("refers-to-page-id"))
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture`` with ``request``, ``answer`` and
    ``metadata``, joined on the concurrent-to identifier."""
    answers = records.where("kind in ('response', 'revisit')").select(
        F.col("record_id").alias("_id"), F.struct("kind", "record_id", "target", "digest", "n_bytes", "payload").alias("answer")
    )
    requests = records.where("kind = 'request'").select(
        F.col("concurrent_to").alias("_id"), F.struct("record_id", "target").alias("request")
    )
    metadata = records.where("kind = 'metadata'").select(
        F.col("concurrent_to").alias("_id"), F.struct("record_id", "page_id", "refers_to").alias("metadata")
    )
    whole = answers.join(requests, "_id", "left").join(metadata, "_id", "left")
    return whole.select(F.struct("request", "answer", "metadata").alias("capture"))


def captures(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder and assemble them."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    return assemble(cut_lineage(read_archives(spark, path, payloads), "records"))
