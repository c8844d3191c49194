"""The output path, model and judge stages, privacy filter, approvals and content keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwarden.functions import spans as sp
from spanwarden.functions import tables as t
from spanwarden.operators import boundary, policy

#: What a privacy finding is called, by pattern.
PRIVACY_LABEL = {"email_address": "private_email", "phone_number": "private_phone", "ssn": "private_ssn", "credit_card": "private_payment"}


def _finding(**values: Column | None) -> Column:
    return F.struct(*[(values[f.name] if values.get(f.name) is not None else F.lit(None)).cast(f.dataType).alias(f.name) for f in sp.FINDING.fields])


def secret_findings(spans: Column, name: str) -> Column:
    """DT-12: spans (s, e) of a registered value as findings."""
    return F.transform(spans, lambda x: _finding(category=F.lit("secrets"), subcategory=F.lit(name), stage=F.lit("registry"), span_start=x["s"], span_end=x["e"], score=F.lit(0.99), evidence=F.lit("registered value"), replacement=F.lit(f"[REDACTED:{name}]")))


def privacy_findings(text: Column, baseline: Column) -> Column:
    """DT-15, JN-06: findings of the personal-data patterns on spans that ``baseline`` does not have."""
    found = F.array().cast(sp.FINDINGS)
    for name, p in t.PII_REGEX:
        has = F.concat(baseline, found)
        taken = F.transform(has, lambda f: F.struct(f["span_start"].alias("s"), f["span_end"].alias("e")))
        new = F.array_except(sp.find_spans(text, p), taken)
        label = PRIVACY_LABEL[name]
        found = F.concat(found, _labelled(new, label))
    return found


def _labelled(spans: Column, label: str) -> Column:
    return F.transform(spans, lambda x: _finding(category=F.lit("leakage"), subcategory=F.lit(label), stage=F.lit("privacy_filter"), span_start=x["s"], span_end=x["e"], score=F.lit(0.82), evidence=F.lit(f"privacy filter: {label}")))


def without_secret_spans(findings: Column, secrets: Column) -> Column:
    """JN-05: leakage findings on exactly a secret's span go."""
    pair = lambda f: F.struct(f["span_start"].alias("s"), f["span_end"].alias("e"))
    return F.filter(findings, lambda f: ~((f["category"] == "leakage") & F.array_contains(F.transform(secrets, pair), pair(f))))


def residuals(findings: Column, secrets: Column) -> Column:
    """JN-03: findings cut down to what lies outside of secrets."""
    holes = F.transform(secrets, lambda f: F.struct(f["span_start"].alias("s"), f["span_end"].alias("e")))
    left = lambda f: sp.subtract(F.array(F.struct(f["span_start"].alias("s"), f["span_end"].alias("e"))), holes)
    return F.flatten(F.transform(findings, lambda f: F.transform(left(f), lambda x: f.withField("span_start", x["s"]).withField("span_end", x["e"]))))


def scan_output(df: DataFrame, rules: policy.Policy = policy.Policy(), text_col: str = "text") -> DataFrame:
    """FN-03: decisions on outputs with columns findings and secrets (arrays of findings).

    Placeholders of registered values stand; the rest of what overlaps them is redacted
    by itself, and forged markers are removed at last.
    """
    kept = without_secret_spans(F.col("findings"), F.col("secrets"))
    df = df.withColumn("findings", F.concat(F.col("secrets"), kept))
    done = policy.finalise(df, rules, text_col)
    own = F.filter("findings", lambda f: f["category"] != "secrets")
    tagged = F.transform(residuals(own, F.col("secrets")), lambda f: f.withField("replacement", sp.replacement(f, rules.mode)))
    both = F.array_sort(F.concat(F.col("secrets"), tagged), lambda a, b: a["span_start"] - b["span_start"])
    # spans that touch would share the first one's tag, so each is put in by itself
    pieces = F.aggregate(both, F.struct(F.lit("").alias("out"), F.lit(0).alias("upto")), lambda a, f: F.when((f["score"] >= rules.redact_threshold) & (f["span_start"] >= a["upto"]) & (f["span_end"] > f["span_start"]), F.struct(F.concat(a["out"], F.substring(F.col(text_col), a["upto"] + 1, f["span_start"] - a["upto"]), F.coalesce(f["replacement"], F.lit(""))).alias("out"), f["span_end"].alias("upto"))).otherwise(a))
    whole = F.concat(pieces["out"], F.substring(F.col(text_col), pieces["upto"] + 1, F.length(text_col)))
    return done.withColumn("redacted_text", F.when(F.size("findings") > 0, boundary.sanitized(whole)))


def with_model(df: DataFrame, load: Callable[[], Callable[[list[str]], list[tuple[float, float]]]], when: Column, text_col: str = "text") -> DataFrame:
    """DT-22: doc_score and span_score of rows where ``when`` holds, from a model loaded once for each worker; null elsewhere."""
    schema = df.withColumns({"doc_score": F.lit(None).cast("double"), "span_score": F.lit(None).cast("double")}).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            need = b.pop("_need").fillna(False).astype(bool)
            b["doc_score"] = b["span_score"] = None
            if need.any():
                model = model or load()
                scores = model(b.loc[need, text_col].tolist())
                b.loc[need, "doc_score"] = [s[0] for s in scores]
                b.loc[need, "span_score"] = [s[1] for s in scores]
            b[["doc_score", "span_score"]] = b[["doc_score", "span_score"]].astype(float)
            yield b

    return df.withColumn("_need", when).mapInPandas(run, schema)


def approval(tool: Column, reasons: Column, risk: Column, act: Column, tainted: Column) -> Column:
    """FN-28: what a person is asked for a call held for review; null for others."""
    ask = F.struct(tool.alias("tool_name"), F.array_join(F.slice(reasons, 1, 8), "; ").alias("reason"), risk.alias("risk_score"), act.alias("action"), tainted.alias("session_tainted"))
    return F.when(act == "review", ask)


def content_key(text: Column, source: Column, fingerprint: str) -> Column:
    """FN-12: key of a scan's result: content, source and policy."""
    return F.sha2(F.concat_ws("|", F.sha2(text, 256), source, F.lit(fingerprint)), 256)


def scan_distinct(df: DataFrame, scan: Callable[[DataFrame], DataFrame], text_col: str = "text", source_col: str = "source") -> DataFrame:
    """JN-11: each distinct content and source scanned once, its result joined back to all rows."""
    keyed = df.withColumn("_key", content_key(F.col(text_col), F.col(source_col), ""))
    once = scan(keyed.select("_key", text_col, source_col).dropDuplicates(["_key"])).drop(text_col, source_col)
    return keyed.join(once, "_key").drop("_key")


def replay(decisions: DataFrame, expected: DataFrame) -> DataFrame:
    """JN-10, AG-16: steps (session_id, seq) with their expectation (safe, min_risk, reasons) and whether it is met."""
    both = expected.join(decisions, ["session_id", "seq"], "left")
    missing = F.array_except(F.coalesce("want_reasons", F.array().cast("array<string>")), F.coalesce("reasons", F.array().cast("array<string>")))
    ok = (F.size(missing) == 0) & F.coalesce(F.col("risk") >= F.coalesce("want_min_risk", F.lit(0.0)), F.lit(False)) & F.coalesce((F.col("action") == "allow") == F.col("want_safe"), F.lit(True))
    return both.withColumns({"missing": missing, "passed": ok})
