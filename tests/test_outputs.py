from pyspark.sql import functions as F

from spanwarden.functions import spans as sp
from spanwarden.operators import outputs


def row(c, s, a, b, v=0.8, r=None):
    return (c, s, "regex", a, b, v, "", r)


def test_output_redaction(spark):
    text = "key SECRETVAL then mail a@b.com end"
    secrets = [row("secrets", "db", 4, 13, 0.99, "[REDACTED:db]")]
    found = [row("leakage", "x", 4, 13), row("leakage", "email_address", 0, 18), row("leakage", "email_address", 24, 31)]
    df = spark.createDataFrame([(1, text, found, secrets)], f"doc_id int, text string, findings {sp.FINDINGS.simpleString()}, secrets {sp.FINDINGS.simpleString()}")
    r = outputs.scan_output(df).head()
    assert [f["category"] for f in r["findings"]] == ["secrets", "leakage", "leakage"] and r["action"] == "block"
    assert r["redacted_text"] == "[BLOCKED:leakage][REDACTED:db][BLOCKED:leakage] mail [BLOCKED:leakage] end"


def test_privacy(spark):
    df = spark.createDataFrame([("a@b.com 123-45-6789", [row("leakage", "email_address", 0, 7)])], f"text string, base {sp.FINDINGS.simpleString()}")
    got = df.select(outputs.privacy_findings(F.col("text"), F.col("base")).alias("x")).head()["x"]
    assert [(f["subcategory"], f["span_start"], f["span_end"]) for f in got] == [("private_ssn", 8, 19)]


def test_model_stage(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bbb"), (3, None)], "doc_id int, text string")
    got = outputs.with_model(df, lambda: lambda texts: [(len(x) / 10, 0.1) for x in texts], F.col("doc_id") == 2).orderBy("doc_id").collect()
    assert [(r["doc_score"], r["span_score"]) for r in got] == [(None, None), (0.3, 0.1), (None, None)]


def test_distinct_and_replay(spark):
    df = spark.createDataFrame([(1, "a", "user"), (2, "a", "user"), (3, "a", "retrieved")], "doc_id int, text string, source string")
    assert outputs.scan_distinct(df, lambda x: x.withColumn("n", F.length("text"))).count() == 3
    d = spark.createDataFrame([("s", 0, "allow", 0.0, []), ("s", 1, "block", 0.9, ["r"])], "session_id string, seq int, action string, risk double, reasons array<string>")
    e = spark.createDataFrame([("s", 0, True, None, None), ("s", 1, False, 0.8, ["r"]), ("s", 2, True, None, None)], "session_id string, seq int, want_safe boolean, want_min_risk double, want_reasons array<string>")
    assert {r["seq"]: r["passed"] for r in outputs.replay(d, e).collect()} == {0: True, 1: True, 2: False}
    ask = d.select(outputs.approval(F.lit("t"), F.col("reasons"), F.col("risk"), F.lit("review"), F.lit(True)).alias("a")).head()["a"]
    assert ask["tool_name"] == "t"
