"""WARC archives with revisit records for repeated payloads."""

from __future__ import annotations

import io
import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.session import cut

FILE_BYTES = 32_000_000  # payload bytes of an archive file, about
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
HEADERS = "record_id string, record_type string, url string, payload_digest string, refers_to_id string, content_bytes long, content_digest string"


def base32_sha1(content: Column) -> Column:
    """Upper-case base32 of the SHA-1: each ten hex digits are eight base-32 digits, in another alphabet."""
    digits = F.sha1(content)
    parts = [F.lpad(F.conv(F.substring(digits, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_payload_headers(pages: DataFrame, payload: str) -> DataFrame:
    """pages with payload (null: empty), payload_bytes and payload_digest."""
    content = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    return pages.withColumn("_payload", content).withColumn("payload_bytes", F.octet_length("_payload").cast("long")).withColumn(
        "payload_digest", base32_sha1(F.col("_payload").cast("binary")))


def resolve_revisits(headers: DataFrame, key: str, least: int = 0) -> DataFrame:
    """headers with record_type and refers_to. Of the records with equal digest and at least least payload bytes, that
    with the largest key is the response and the others revisit it; smaller ones are all responses.

    Only headers are grouped, with maxima taken before the shuffle; a digest that a third of the records share is split
    by the skew join. Records that share the largest key are all responses; so are those of a digest without any key.
    A record without key revisits the keyed one.
    """
    first = headers.groupBy("payload_digest").agg(F.max(key).alias("_first")).withColumnRenamed("payload_digest", "_digest")
    both = headers.join(first, F.col("payload_digest") == F.col("_digest"), "left")
    again = (F.col("payload_bytes") >= least) & F.col("_first").isNotNull() & ~F.col(key).eqNullSafe(F.col("_first"))
    return both.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(again, F.col("_first"))).drop("_first", "_digest")


def _record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(key.cast("string"), F.lit("none")), F.lit(">"))


def write_archives(records: DataFrame, path: str, key: str, url: str) -> None:
    """One record per row with the columns of resolve_revisits and with_payload_headers, in gzip files under path.

    A response carries its payload; a revisit has fresh headers that name the response and no payload. Records end with
    two line breaks, which is how Spark's text writer separates rows, so its committer makes lost tasks harmless. Every
    partition of records is a file.
    """
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    clean = F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), "[\\r\\n]+", " ")
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col(key))),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"), F.when(revisit, "").otherwise(F.col("_payload")))
    records.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _unzipped(data: bytes) -> io.BufferedIOBase:
    """The plain archive: gzip members one after the other, or no gzip at all."""
    if data[:2] != b"\x1f\x8b":
        return io.BytesIO(data)
    out = io.BytesIO()
    while data:
        member = zlib.decompressobj(31)
        out.write(member.decompress(data))
        data = member.unused_data
    out.seek(0)
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, content) of each record, by Content-Length, so that contents may hold anything."""
    f = _unzipped(data)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, f.read(int(headers.get("content-length") or 0))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row of HEADERS per record under path, with digest and size of the content as it is read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64
        import hashlib

        names = [x.split()[0] for x in HEADERS.split(", ")]
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for h, content in parse(data.as_py()):
                    digest = base64.b32encode(hashlib.sha1(content).digest()).decode()
                    rows.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), re.sub("^sha1:", "", h.get("warc-payload-digest", "")),
                                 h.get("warc-refers-to"), len(content), digest))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 5 else pa.string()) for i, c in enumerate(zip(*rows))] if rows else [
                    pa.array([], pa.int64() if i == 5 else pa.string()) for i in range(len(names))], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, HEADERS)


def restore(headers: DataFrame) -> DataFrame:
    """headers with payload_bytes and payload_digest of the full payload: a response's own, a revisit's those of the
    response that it refers to, found by the record's id (missing there: null)."""
    own = headers.filter("record_type = 'response'").groupBy("record_id").agg(
        F.min("content_bytes").alias("_bytes"), F.min("content_digest").alias("_digest")).withColumnRenamed("record_id", "_id")
    revisit = headers.filter("record_type = 'revisit'").join(own, F.col("refers_to_id") == F.col("_id"), "left")
    plain = [F.col(c) for c in headers.columns if c != "payload_digest"]
    again = revisit.select(*plain, F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"))
    return headers.filter("record_type <> 'revisit'").select(
        *plain, F.col("content_bytes").alias("payload_bytes"), F.col("content_digest").alias("payload_digest")).unionByName(again)


def key_of(record_id: str = "record_id") -> Column:
    """The key that a record's id was made from."""
    return F.regexp_extract(record_id, "<urn:record:(.*)>", 1).try_cast("long")


def deduplicate(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> None:
    """Write pages as archives under path in which every repeated payload is stored once (see resolve_revisits).

    Null payloads are empty, null urls too. Headers alone are shuffled by digest; payloads are shuffled once, by key and
    digest, and meet there what their headers were resolved to. Files get about FILE_BYTES of payload each. Repeated rows
    give a record each; an empty table gives empty archives. Other columns play no part.
    """
    full = with_payload_headers(pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload")), "payload")
    headers = cut(full.select("key", "payload_bytes", "payload_digest"), "headers")
    files = max(2, math.ceil((headers.agg(F.sum("payload_bytes")).first()[0] or 0) / FILE_BYTES))
    place = F.concat_ws("|", F.col("payload_digest"), F.col("key").cast("string"))
    again = resolve_revisits(headers, "key", least).filter("record_type = 'revisit'").select(place.alias("place"), "refers_to").distinct()
    # What headers were resolved to travels among the payloads: a join may deal them once more, in as many parts as other shuffles have.
    both = full.withColumns({"place": place, "refers_to": F.lit(None).cast(headers.schema["key"].dataType), "page": F.lit(True)}).unionByName(
        again.withColumn("page", F.lit(False)), allowMissingColumns=True).repartition(files, "place")
    rows = both.withColumn("refers_to", F.max("refers_to").over(Window.partitionBy("place"))).filter("page")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    write_archives(rows.withColumn("record_type", kind), path, "key", "url")
