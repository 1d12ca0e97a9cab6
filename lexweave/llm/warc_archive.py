"""A content-addressed archive of WARC records.

Payload bytes are stored once, in a table bucketed and sorted by their SHA-256 digest; the exact header
of every record stands in a table of its own. Before payloads are taken to be equal, their lengths and
SHA-1 digests must agree as well, and reading verifies each payload against both digests. Records are
rebuilt by a sort-merge join that moves headers but no payloads. Files of records are written and read
in the common format.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.shared import ROW, hot_join, numbered, saved, shared_dir, small_batches

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Date of records whose time isn't known.
NO_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def sha1_base32(payload: Column) -> Column:
    """The SHA-1 digest in upper-case base32: five hexadecimal digits are four of base32."""
    digest, out = F.sha1(payload), []
    for k in range(8):
        part = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(_ALPHABET), F.shiftright(part, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _record_id(row: Column) -> Column:
    """A URN for a row number, the same at every writing."""
    h = F.md5(row.cast("string").cast("binary"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _line(name: str, value: Column | str) -> Column:
    """A header line; nothing where the value is null."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END)), F.lit(""))


def _uri(url: Column) -> Column:
    """The URL with blanks and control characters escaped, as they would end the header's line."""
    for c in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return url


def _header(kind: Column, url: Column, http: Column, payload_bytes: Column, date: str) -> Column:
    """The lines of a response or a revisit, both without their ends: the record's and the HTTP header, as exact text."""
    revisit = kind == "revisit"
    block = F.char_length(http) + F.when(revisit, 0).otherwise(payload_bytes)
    return F.concat(
        F.lit(f"WARC/1.1{_END}"), _line("WARC-Type", kind), _line("WARC-Record-ID", _record_id(F.col(ROW))), _line("WARC-Date", date), _line("WARC-Target-URI", _uri(url)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Profile", _PROFILE), _line("WARC-Refers-To", _record_id(F.col("first_row"))))).otherwise(""),
        _line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", block), F.lit(_END), http,
    )


class Archive:
    """The two tables of an archive below ``path``: payloads (digest, payload) and headers (page_id, kind, digest, header, inline, refers_to).

    ``inline`` is the payload of a record that is kept with its header, being shorter than ``least``.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.table = f"payloads_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, pages: DataFrame, least: int = 0, date: str = NO_DATE) -> None:
        """Store a record for each row of pages (page_id, url, html); a null html has an empty payload.

        Of rows with equal payloads of ``least`` bytes or more, that with the smallest page_id (null is
        larger than any, ties go to the first row) is the response, the others revisit it; shorter ones
        are all responses. A null url has no header line. Payloads of any length are taken whole, repeated
        rows have records of their own, other columns are ignored, and an empty table gives an empty archive.
        """
        pages = numbered(pages)
        payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
        rows = pages.select(ROW, F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
        rows = rows.withColumns({"digest": F.unhex(F.sha2("payload", 256)), "payload_bytes": F.octet_length("payload").cast("long"), "sha1": sha1_base32(F.col("payload"))})
        short = F.col("payload_bytes") < least
        # one payload for each digest leaves a map task, so that a group of copies isn't gathered
        whole = rows.filter(~short).groupBy("digest").agg(
            F.any_value("payload").alias("payload"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", ROW)).alias("first"), F.count("*").alias("copies"),
            F.min(F.struct("payload_bytes", "sha1")).alias("low"), F.max(F.struct("payload_bytes", "sha1")).alias("high"),
        )
        one = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.lit("different payloads share a SHA-256 digest")))
        stored = whole.select("digest", one.alias("payload"), F.col("first.page_id").alias("refers_to"), F.col(f"first.{ROW}").alias("first_row"), "copies")
        stored.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/payloads").saveAsTable(self.table)

        meta = saved(rows.select(ROW, "page_id", "url", "digest", "payload_bytes", "sha1", F.when(short, F.col("payload")).alias("inline")), "warc-meta")
        groups = self.spark.table(self.table).select("digest", "refers_to", "first_row", "copies")
        named = hot_join(meta.filter("inline IS NULL"), groups, "digest", "copies", meta.count()).drop("copies")
        named = named.unionByName(meta.filter("inline IS NOT NULL").withColumns({"refers_to": F.lit(None).cast("long"), "first_row": F.col(ROW)}))
        kind = F.when(F.col(ROW) == F.col("first_row"), "response").otherwise("revisit")
        http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END * 2))
        named = named.withColumns({"kind": kind, "http": http})
        named = named.withColumn("header", _header(F.col("kind"), F.col("url"), F.col("http"), F.col("payload_bytes"), date))
        named.select(ROW, "page_id", "kind", "digest", F.encode("header", "UTF-8").alias("header"), "inline", F.when(F.col("kind") == "revisit", F.col("refers_to")).alias("refers_to")).write.parquet(f"{self.path}/headers")

    def headers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/headers")

    def payloads(self) -> DataFrame:
        """(digest, payload) of all stored payloads; a payload that isn't what its digest says raises an error."""
        good = F.unhex(F.sha2("payload", 256)) == F.col("digest")
        return self.spark.table(self.table).select("digest", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.hex("digest")))).alias("payload"))

    def responses(self) -> DataFrame:
        """(page_id, digest, record): the records that have payloads, each with exactly its bytes."""
        headers = self.headers().filter("kind = 'response'")
        joined = headers.filter("inline IS NULL").join(self.payloads().hint("merge"), "digest")
        rows = joined.select("page_id", "digest", "header", "payload").unionByName(headers.filter("inline IS NOT NULL").select("page_id", "digest", "header", F.col("inline").alias("payload")))
        return rows.select("page_id", "digest", F.concat("header", "payload").alias("record"))

    def records(self) -> DataFrame:
        """(page_id, record) of all records, as they were written; revisits have no payload."""
        revisits = self.headers().filter("kind = 'revisit'").select("page_id", F.col("header").alias("record"))
        return self.responses().select("page_id", "record").unionByName(revisits)


def parsed(records: DataFrame) -> DataFrame:
    """records (record, ...) with kind, uri, payload_digest, payload: what a record's own bytes say.

    The header ends at the first empty line, the HTTP header at the next; Content-Length tells where the
    block ends. Bytes that aren't as long as that, or whose SHA-1 isn't the header's, raise an error.
    """
    head = F.substring_index(F.col("record").cast("string"), _END * 2, 1)
    field = lambda name: F.nullif(F.regexp_extract("__head", rf"(?md)^{name}: ([^\r\n]*)", 1), F.lit(""))
    http = F.substring_index(F.expr("cast(substring(record, octet_length(__head) + 5) as string)"), _END * 2, 1)
    rows = records.withColumn("__head", head).withColumn("__http", http)
    rows = rows.withColumns({"kind": field("WARC-Type"), "uri": field("WARC-Target-URI"), "payload_digest": F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", ""), "__length": field("Content-Length").cast("long")})
    payload = F.expr("substring(record, octet_length(__head) + octet_length(__http) + 9)")
    whole = F.octet_length("record") == F.octet_length("__head") + 4 + F.col("__length")
    rows = rows.withColumn("payload", F.when(whole, payload).otherwise(F.raise_error(F.lit("a record's length isn't its Content-Length"))))
    same = (F.col("kind") != "response") | (sha1_base32(F.col("payload")) == F.col("payload_digest"))
    return rows.withColumn("payload", F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("a payload's digest isn't its header's")))).drop("__head", "__http", "__length")


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records (record, ...) as WARC files, one for each partition. The writer's line end is what stands between records."""
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", _END * 2).option("compression", compression).text(path)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content) of whole files -> (record): header and block, cut by Content-Length."""
    for batch in batches:
        for content in batch.column("content"):
            data = io.BytesIO(content.as_buffer())
            if data.read(2) == b"\x1f\x8b":
                data.seek(0)
                data = gzip.open(data)
            else:
                data.seek(0)
            while line := data.readline():
                if not line.strip():
                    continue
                head = [line]
                while (line := data.readline()).strip():
                    head.append(line)
                head.append(line)
                length = next(int(x.split(b":", 1)[1]) for x in head if x.lower().startswith(b"content-length:"))
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(head) + data.read(length)], pa.binary())], ["record"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record) of the WARC files of a folder, compressed or not; a file is read by one task, record by record."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_split, "record binary")


def op12_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's payload length and digest, and whether its record is a response or revisits another, from the archive that was written."""
    small_batches(spark)
    archive = Archive(spark, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    archive.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = parsed(archive.responses()).select("page_id", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"))
    found = saved(found, "warc-responses")
    revisits = archive.headers().filter("kind = 'revisit'").select("page_id", "digest", F.col("header").alias("record"), "refers_to")
    copies = revisits.groupBy("digest").agg(F.count("*").alias("copies"))
    known = saved(found.select("digest", "payload_bytes", F.col("payload_digest").alias("digest_of_response")).join(copies, "digest"), "warc-revisited")
    seen = hot_join(parsed(revisits), known, "digest", "copies", revisits.count())
    same = F.when(F.col("payload_digest") == F.col("digest_of_response"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a revisit's digest isn't its response's")))
    out = found.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return out.unionByName(seen.select("page_id", "payload_bytes", same.alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS html FROM pages),
n AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: '{_ALPHABET}'[((('0x' || h[(i // 4) * 5 + 1 : (i // 4) * 5 + 5])::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM n
"""
