"""Span arithmetic as Spark columns: extraction, merging, coverage, subtraction, redaction.

Offsets are code points, half-open. A finding is a struct; see FINDING.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwarden.functions.regexes import java

FINDING = T.StructType([
    T.StructField("category", T.StringType()), T.StructField("subcategory", T.StringType()), T.StructField("stage", T.StringType()),
    T.StructField("span_start", T.IntegerType()), T.StructField("span_end", T.IntegerType()), T.StructField("score", T.DoubleType()),
    T.StructField("evidence", T.StringType()), T.StructField("replacement", T.StringType()),
])
FINDINGS = T.ArrayType(FINDING)
PAIRS = "array<struct<s:int,e:int>>"


def find_spans(text: Column, pattern: str) -> Column:
    """Spans (s, e) of all matches of a pattern that never matches the empty string.

    Gaps come from splitting, matches from extraction; running lengths give offsets.
    """
    p = java(pattern)
    gaps = F.transform(F.split(text, p, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)), F.length)
    total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda x, y: x + y)
    place = lambda h, i: total(gaps, i + 1) + total(hits, i)
    found = F.transform(hits, lambda h, i: F.struct(place(h, i).alias("s"), (place(h, i) + h).alias("e")))
    return F.when(text.rlike(p), found).otherwise(F.array().cast(PAIRS))


def flagged(findings: Column, least: Column | float) -> Column:
    """Spans of findings at or above ``least`` that are not empty, as (s, e)."""
    kept = F.filter(findings, lambda f: (f["score"] >= least) & (f["span_end"] > f["span_start"]))
    return F.transform(kept, lambda f: F.struct(f["span_start"].alias("s"), f["span_end"].alias("e")))


def merged(spans: Column) -> Column:
    """Spans (s, e) sorted by start, with those that touch or overlap joined."""

    def add(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        touches = (F.size(out) > 0) & (x["s"] <= F.try_element_at(out, F.lit(-1))["e"])
        return F.when(touches, joined).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(PAIRS), add)


def covered(spans: Column) -> Column:
    return F.aggregate(merged(spans), F.lit(0), lambda a, x: a + (x["e"] - x["s"]))


def coverage(findings: Column, text_len: Column, least: Column | float) -> Column:
    """Share of the text that flagged spans cover, 1 at most; 0 for an empty text."""
    share = F.try_divide(covered(flagged(findings, least)).cast("double"), text_len)
    return F.when(text_len > 0, F.least(F.lit(1.0), share)).otherwise(F.lit(0.0))


def subtract(spans: Column, holes: Column) -> Column:
    """What is left of each span outside of ``holes``."""

    def cut(out: Column, h: Column) -> Column:
        parts = lambda x: F.filter(F.array(F.struct(x["s"].alias("s"), F.least(x["e"], h["s"]).alias("e")), F.struct(F.greatest(x["s"], h["e"]).alias("s"), x["e"].alias("e"))), lambda y: y["e"] > y["s"])
        return F.flatten(F.transform(out, lambda x: F.when((h["e"] <= x["s"]) | (h["s"] >= x["e"]), F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))).otherwise(parts(x))))

    return F.aggregate(merged(holes), spans.cast(PAIRS), cut)


def replacement(f: Column, mode: str) -> Column:
    if mode == "redacted_tags":
        return F.coalesce(f["replacement"], F.concat(F.lit("[REDACTED:"), f["category"], F.lit("]")))
    return F.concat(F.lit("[BLOCKED:"), f["category"], F.lit("]")) if mode == "blocked_tags" else F.lit("")


def redact(text: Column, findings: Column, least: Column | float, mode: str = "blocked_tags") -> Column:
    """The text with flagged spans replaced; of spans that touch, the first one's tag stands for all. Null for mode none."""
    if mode == "none":
        return F.lit(None).cast("string")
    kept = F.filter(findings, lambda f: (f["score"] >= least) & (f["span_end"] > f["span_start"]))
    # equal starts keep their order in the list
    marked = F.array_sort(F.transform(kept, lambda f, i: F.struct(f["span_start"].alias("s"), i.alias("i"), f["span_end"].alias("e"), replacement(f, mode).alias("r"))))
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("upto"))

    def add(acc: Column, x: Column) -> Column:
        apart = x["s"] > acc["upto"]
        first = (acc["upto"] == 0) & (acc["out"] == "")
        fresh = F.concat(acc["out"], F.substring(text, acc["upto"] + 1, x["s"] - acc["upto"]), x["r"])
        return F.struct(F.when(apart | first, fresh).otherwise(acc["out"]).alias("out"), F.greatest(acc["upto"], x["e"]).alias("upto"))

    done = F.aggregate(marked, state, add)
    return F.when(F.size(kept) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["upto"] + 1, F.length(text))))
