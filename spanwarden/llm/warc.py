"""WARC archives with revisit records in place of repeated payloads.

Archives are written by Spark's text writer, compressed: a record's line ends with the
two line breaks that close a WARC record, so each part file is a valid .warc.gz, and the
commit protocol makes retried tasks harmless. They are read back as whole files and
parsed by their length headers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwarden.session import new_path, stored

EOL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "
#: Bytes of payload that an archive holds, about.
ARCHIVE_BYTES = 16 << 20


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits make four of base 32."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def resolve_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, digest, n_bytes, original: for each row, the largest page_id with its payload.

    Only headers are shuffled by digest, and the largest id is aggregated before the
    shuffle, so a payload that many pages share costs one row for each task; the join
    that brings it back carries no payload. Payloads below ``least_bytes`` keep their own id.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    heads = stored(pages.select("page_id", F.regexp_replace("url", r"[\r\n]", "").alias("url"), payload_digest(payload).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes")), "warc-headers")
    latest = heads.filter(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("latest"), F.max_by("url", "page_id").alias("latest_url"))
    small = F.col("n_bytes") < least_bytes
    return heads.join(latest, "digest", "left").withColumn("original", F.when(small, F.col("page_id")).otherwise(F.col("latest"))).drop("latest")


def record(kind: str, date: str, payload: Column | None) -> Column:
    """The text of a record from the columns page_id, url, digest, n_bytes, original and latest_url."""
    http = F.concat(F.lit(HTTP), F.col("n_bytes").cast("string"), F.lit(EOL * 2))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    lines = [F.lit(f"WARC/1.1{EOL}WARC-Type: {kind}{EOL}WARC-Date: {date}{EOL}"), line("WARC-Record-ID", page_urn(F.col("page_id")))]
    lines += [F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    if payload is None:
        lines += [line("WARC-Refers-To", page_urn(F.col("original"))), F.coalesce(line("WARC-Refers-To-Target-URI", F.col("latest_url")), F.lit("")), F.lit(f"WARC-Profile: {PROFILE}{EOL}")]
    length = F.octet_length(http).cast("long") + (F.lit(0) if payload is None else F.col("n_bytes"))
    lines += [F.lit(f"Content-Type: application/http; msgtype=response{EOL}"), line("Content-Length", length.cast("string")), F.lit(EOL), http]
    return F.concat(*lines, *([] if payload is None else [payload]))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html) to archives in ``path``.

    Of rows with equal payloads, those with the largest page_id are responses; the others
    are revisits that refer to it and carry no payload. A null html is an empty payload,
    a null url has no target header, and a null page_id counts as the smallest. Rows that
    repeat the largest page_id with the same payload are all responses. Other columns are
    not read.
    """
    heads = stored(resolve_revisits(pages, least_bytes), "warc-resolved")
    own = F.col("page_id").eqNullSafe(F.col("original"))
    total = heads.agg(F.sum(F.when(own, F.col("n_bytes")).otherwise(0) + 600), F.count("*")).head()
    each = max(1, int(ARCHIVE_BYTES * total[1] / max(total[0] or 1, 1)))
    firsts = heads.filter(own).select("page_id", "digest").distinct().select(F.col("page_id").alias("first_id"), F.col("digest").alias("first_digest"))
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    full = pages.select("page_id", F.regexp_replace("url", r"[\r\n]", "").alias("url"), payload.alias("payload")).withColumns({"digest": payload_digest(F.col("payload")), "n_bytes": F.octet_length("payload").cast("long")})
    kept = full.join(firsts, F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest")))
    records = kept.select(record("response", date, F.col("payload")).alias("value")).unionAll(heads.filter(~own).select(record("revisit", date, None).alias("value")))
    records.write.option("lineSep", EOL * 2).option("maxRecordsPerFile", each).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers and block of each record of an archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split(EOL)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        size = int(head["Content-Length"])
        yield head, view[end + 4 : end + 4 + size]
        at = end + 8 + size


def _page(urn: str | None) -> int | None:
    value = urn[len("<urn:x-page:") : -1] if urn else "none"
    return None if value == "none" else int(value)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of each record.

    Size and digest of a response are taken from the payload itself; those of a revisit
    from its headers, as it has no payload.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for data in b.column(0):
                rows = []
                for head, block in parse(gzip.decompress(data.as_py())):
                    split = bytes(block[:400]).index(b"\r\n\r\n") + 4
                    size, digest = len(block) - split, base64.b32encode(hashlib.sha1(block[split:]).digest()).decode()
                    if head["WARC-Type"] == "revisit":
                        size, digest = int(bytes(block[:split]).split(b"Content-Length: ")[1].split(b"\r")[0]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    rows.append((_page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], _page(head.get("WARC-Refers-To"))))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter(F.col("length") > 0).select("content")
    return files.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def deduplicated_archives(pages: DataFrame) -> DataFrame:
    """Writes archives of ``pages`` in the shared folder and reads them back; empty for an empty table."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
