import base64
import hashlib

from pyspark.sql import functions as F

from spanwarden.llm import warc


def test_round_trip(spark):
    rows = [(1, "http://a", "<p>x</p>"), (5, "http://b", "<p>x</p>"), (3, None, "<p>x</p>"), (2, "u\r\nX: y", ""), (9, "c", None), (4, "d", "é\r\n\r\nWARC/1.1\r\n\r\n"), (7, "e", "\r\n" * 5), (None, "f", "<p>x</p>"), (5, "http://b", "<p>x</p>"), (None, "g", "alone"), (8, "h", "z" * 100_000)]
    pages = spark.createDataFrame([(*r, 1, "q") for r in rows], "page_id long, url string, html string, digest int, latest string")
    got = sorted(map(tuple, warc.deduplicated_archives(pages).drop("url").collect()), key=str)
    key = lambda x: -1 if x is None else x
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = max((p for p, _, k in rows if (k or "") == (h or "")), key=key)
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert got == sorted(want, key=str)
    assert warc.deduplicated_archives(pages.limit(0)).count() == 0


def test_revisits_have_no_payload(spark):
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("same " * 1000).alias("html"))
    path = warc.new_path(spark, "warc-test")
    warc.write_archives(pages, path)
    assert spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).agg(F.sum("length")).head()[0] < 40_000
    assert warc.read_archives(spark, path).groupBy("record_type").count().orderBy("record_type").collect() == [("response", 1), ("revisit", 49)]
