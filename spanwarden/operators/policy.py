"""Decisions from findings: risk, coverage, action, redaction. All are Spark columns."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwarden.functions import tables as t
from spanwarden.functions.regexes import java
from spanwarden.functions.spans import coverage, redact


@dataclasses.dataclass(frozen=True)
class Policy:
    block_coverage: float = 0.2
    redact_threshold: float = 0.5
    review_threshold: float = 0.3
    block_threshold: float = 0.8
    mode: str = "blocked_tags"
    abstain: bool = True
    abstain_is_safe: bool = False
    sensitive_boost: float = 0.2
    sensitive_block_delta: float = -0.15
    most_chars: int = 50_000


def with_overrides(policy: Policy, **columns: Column) -> dict[str, Column]:
    """DC-03: each threshold as a column; a row's own value wins where it is not null."""
    base = {k: F.lit(getattr(policy, k)) for k in ("block_coverage", "redact_threshold", "review_threshold", "block_threshold")}
    return base | {k: F.coalesce(c, base[k]) for k, c in columns.items()}


def risk(findings: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(findings, lambda f: f["score"])), F.lit(0.0))


def stages_run(findings: Column) -> Column:
    return F.array_distinct(F.transform(findings, lambda f: f["category"]))


def sensitive(text: Column) -> Column:
    return text.rlike(java(t.SENSITIVE))


def boosted(findings: Column, text: Column, policy: Policy) -> Column:
    """FN-18: injection and leakage score higher where the text is about credentials."""
    up = F.transform(findings, lambda f: F.when(f["category"].isin("injection", "leakage") & (f["stage"] != "llm_judge"), f.withField("score", F.least(F.lit(1.0), f["score"] + policy.sensitive_boost))).otherwise(f))
    return F.when(sensitive(text), up).otherwise(findings)


def block_threshold(findings: Column, text: Column, policy: Policy, base: Column | None = None) -> Column:
    hit = F.exists(findings, lambda f: f["category"].isin("injection", "leakage") & (f["stage"] != "llm_judge"))
    base = F.lit(policy.block_threshold) if base is None else base
    return F.when(sensitive(text) & hit, base + policy.sensitive_block_delta).otherwise(base)


def action(findings: Column, text_len: Column, risk_score: Column, policy: Policy = Policy(), **own: Column) -> Column:
    """DC-01: coverage, block, abstain, redact, review, allow, in this order."""
    p = with_overrides(policy, **own)
    abstains = F.exists(findings, lambda f: f["subcategory"] == "ml_abstain") if policy.abstain else F.lit(False)
    return (
        F.when((text_len > 0) & (coverage(findings, text_len, p["redact_threshold"]) >= p["block_coverage"]), "block")
        .when(risk_score >= p["block_threshold"], "block")
        .when(abstains, "abstain")
        .when(F.exists(findings, lambda f: f["score"] >= p["redact_threshold"]), "redact")
        .when(risk_score >= p["review_threshold"], "review")
        .otherwise("allow")
    )


def safe(act: Column, policy: Policy = Policy()) -> Column:
    return (act == "allow") | ((act == "abstain") & F.lit(policy.abstain_is_safe))


def finalise(df: DataFrame, policy: Policy = Policy(), text_col: str = "text") -> DataFrame:
    """DC-07: boost, effective thresholds, risk, action, redaction. Over-long texts block unscanned (PF-03)."""
    text, long = F.col(text_col), F.length(text_col) > policy.most_chars
    df = df.withColumn("findings", boosted(F.col("findings"), text, policy))
    df = df.withColumns({"risk_score": F.when(long, F.lit(1.0)).otherwise(risk(F.col("findings"))), "stages_run": stages_run(F.col("findings")), "_block": block_threshold(F.col("findings"), text, policy)})
    df = df.withColumn("action", F.when(long, "block").otherwise(action(F.col("findings"), F.length(text), F.col("risk_score"), policy, block_threshold=F.col("_block"))))
    cleaned = F.when(F.col("action").isin("redact", "block", "abstain") & ~long, redact(text, F.col("findings"), policy.redact_threshold, policy.mode))
    return df.withColumns({"safe": safe(F.col("action"), policy), "redacted_text": cleaned}).drop("_block")


def fires(doc: Column, span: Column, mode: str, tau_doc: float, tau_span: float, tau_gate: float) -> Column:
    d, s = doc >= tau_doc, span >= tau_span
    return d if mode == "doc_only" else d & (s | (doc >= tau_gate)) if mode == "doc_gated" else d | s


def band(doc: Column, span: Column, mode: str = "doc_or_span", tau_doc: float = 0.5, tau_span: float = 0.5, tau_low: float = 0.35, tau_gate: float = 0.99, abstain: bool = True) -> Column:
    """DC-04: block, abstain or allow from a model's document and span scores."""
    out = F.when(fires(doc, span, mode, tau_doc, tau_span, tau_gate), "block")
    if not abstain:
        return out.otherwise("allow")
    holds = F.lit(False) if mode == "doc_only" else span >= tau_span
    return out.when((doc < tau_low) & ~holds, "allow").otherwise("abstain")


def calibration(doc: Column, span: Column, mode: str, tau_doc: float = 0.5, tau_gate: float = 0.99) -> Column:
    """DC-05: one score for a sweep of thresholds."""
    both = F.greatest(doc, span)
    if mode == "doc_gated":
        return F.when(doc < tau_doc, F.lit(0.0)).when(doc >= tau_gate, both).otherwise(span)
    return doc if mode == "doc_only" else both


def disposition(doc: Column, harm: Column, span: Column, tau_harm: float = 0.7, tau_doc: float = 0.45, tau_span: float = 0.5) -> Column:
    """DC-06: label and score."""
    pair = lambda label, s: F.struct(F.lit(label).alias("label"), s.alias("score"))
    return F.when(span >= tau_span, pair("injection", span)).when(harm >= tau_harm, pair("harmful_not_injection", harm)).when(doc >= tau_doc, pair("injection", doc)).otherwise(pair("benign", 1.0 - F.greatest(doc, harm)))


def judge_score(act: Column, score: Column, review: float = 0.3, block: float = 0.8) -> Column:
    """DT-25: a judge's score moved into the band of its action."""
    low = lambda x: F.lit(__import__("math").nextafter(x, 0.0))
    return F.when(act == "block", F.greatest(score, F.lit(block))).when(act == "review", F.least(F.greatest(score, F.lit(review)), low(block))).when(act == "allow", F.least(score, low(review))).otherwise(score)


def ml_gate(risk_score: Column, flagged: Column, gray_low: float = 0.3, gray_high: float = 0.8, always: bool = False) -> Column:
    """PF-13: whether the model has to see a row."""
    return (risk_score < gray_high) & (F.lit(always) | flagged | (risk_score >= gray_low))


def judge_gate(findings: Column, risk_score: Column, low: float = 0.3, high: float = 0.8) -> Column:
    """PF-14."""
    return F.exists(findings, lambda f: f["subcategory"] == "ml_abstain") | ((risk_score >= low) & (risk_score < high))
