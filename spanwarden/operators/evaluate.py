"""Detection quality and run statistics."""

from __future__ import annotations

import codecs

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counts(hit: Column, label: Column) -> list[Column]:
    return [F.count_if(hit & (label == 1)).alias("tp"), F.count_if(hit & (label == 0)).alias("fp"), F.count_if(~hit & (label == 1)).alias("fn"), F.count_if(~hit & (label == 0)).alias("tn")]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def confusion(results: DataFrame, threshold: float = 0.5, risk: str = "risk_score", label: str = "label") -> DataFrame:
    """AG-07."""
    return results.agg(*_counts(F.col(risk) >= threshold, F.col(label)))


def with_rates(counts: DataFrame) -> DataFrame:
    """AG-08: precision, recall, F1 and false-positive rate; 0 without a denominator."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "fpr": _ratio(fp, fp + tn)})


def by_category(results: DataFrame, threshold: float = 0.5, category: str = "category") -> DataFrame:
    """Counts and rates for each category and, with a null category, over all rows."""
    grouped = results.groupingSets([[category], []], category).agg(*_counts(F.col("risk_score") >= threshold, F.col("label")), F.grouping_id().alias("_all"))
    return with_rates(grouped).withColumn(category, F.when(F.col("_all") == 0, F.col(category))).drop("_all")


def sweep(results: DataFrame, thresholds: list[float]) -> DataFrame:
    """Counts at several thresholds, in one pass: rows are counted by score class before they meet a threshold."""
    cuts = sorted(thresholds)
    level = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda a, x: a + (F.col("risk_score") >= x).cast("int"))
    classes = results.groupBy(level.alias("level"), "label").agg(F.count("*").alias("n"))
    table = F.explode(F.array(*[F.struct(F.lit(x).alias("threshold"), F.lit(k + 1).alias("need")) for k, x in enumerate(cuts)]))
    each = classes.withColumn("cut", table).select("n", "label", "cut.threshold", (F.col("level") >= F.col("cut.need")).alias("hit"))
    total = lambda hit, label: F.coalesce(F.sum(F.when((F.col("hit") == hit) & (F.col("label") == label), F.col("n"))), F.lit(0))
    return each.groupBy("threshold").agg(total(True, 1).alias("tp"), total(True, 0).alias("fp"), total(False, 1).alias("fn"), total(False, 0).alias("tn"))


def gate(rates: DataFrame, floors: DataFrame) -> DataFrame:
    """AG-10: a row for each floor or ceiling (metric, least, most) and whether it is met."""
    long = rates.unpivot([], ["precision", "recall", "f1", "fpr"], "metric", "value")
    return floors.join(long, "metric", "left").withColumn("met", F.coalesce(F.col("value") >= F.coalesce("least", F.lit(float("-inf"))), F.lit(False)) & F.coalesce(F.col("value") <= F.coalesce("most", F.lit(float("inf"))), F.lit(False)))


def scanner_stats(scanned: DataFrame) -> DataFrame:
    """AG-05: rows and findings of each category."""
    numbered = scanned.select("findings", F.monotonically_increasing_id().alias("r"))
    each = numbered.select(F.explode("findings").alias("f"), "r")
    return each.groupBy(F.col("f.category").alias("category")).agg(F.count("*").alias("n_findings"), F.count_distinct("r").alias("n_rows"))


def pipeline_stats(scanned: DataFrame) -> DataFrame:
    """AG-06: runs by action; abstain counts as allowed."""
    n = lambda *x: F.count_if(F.col("action").isin(*x))
    return scanned.agg(F.count("*").alias("n_runs"), n("block").alias("n_blocked"), n("redact").alias("n_redacted"), n("review").alias("n_reviewed"), n("allow", "abstain").alias("n_allowed"))




ROT13 = "".join(map(chr, [*range(65, 91), *range(97, 123)]))

MORSE = dict(zip("abcdefghijklmnopqrstuvwxyz ", ".- -... -.-. -.. . ..-. --. .... .. .--- -.- .-.. -- -. --- .--. --.- .-. ... - ..- ...- .-- -..- -.-- --.. /".split()))
ASCII = "".join(map(chr, range(1, 0x7F)))

#: Payload converters, by name: eleven of the attack matrix, and literal, upper and markdown of our own.
CONVERTERS = {
    "literal": lambda c: c,
    "base64": lambda c: F.base64(c.cast("binary")),
    "rot13": lambda c: F.translate(c, ROT13, codecs.encode(ROT13, "rot13")),
    "hex": lambda c: F.lower(F.hex(c.cast("binary"))),
    "url_encode": lambda c: F.url_encode(c),
    "reversed": lambda c: F.reverse(c),
    "upper": lambda c: F.upper(c),
    "leet": lambda c: F.translate(c, "eaiost", "341057"),
    "zero_width": lambda c: F.array_join(F.split(c, ""), "​"),
    "spaced_letters": lambda c: F.array_join(F.transform(F.split(c, " "), lambda w: F.array_join(F.split(w, ""), " ")), "  "),
    "dotted": lambda c: F.array_join(F.transform(F.split(c, " "), lambda w: F.array_join(F.split(w, ""), ".")), " "),
    "homoglyph": lambda c: F.translate(c, "aeopc", "аеорс"),
    "fullwidth": lambda c: F.translate(c, "abcdefghijklmnopqrstuvwxyz", "".join(chr(0xFF41 + k) for k in range(26))),
    "markdown": lambda c: F.concat(F.lit("**"), c, F.lit("**")),
}
#: FN-22: the 14 converters of the attack matrix.
ATTACKS = {k: f for k, f in CONVERTERS.items() if k not in ("literal", "upper", "markdown")} | {
    "morse": lambda c: F.array_join(F.transform(F.split(F.lower(c), ""), lambda x: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in MORSE.items() for v in kv]), x), x)), " "),
    "unicode_tags": lambda c: F.translate(c, ASCII, "".join(chr(0xE0000 + ord(x)) for x in ASCII)),
    "mixed_case": lambda c: F.array_join(F.transform(F.split(c, ""), lambda x, i: F.when(i % 2 == 1, F.upper(x)).otherwise(F.lower(x))), ""),
}


def converted(payloads: DataFrame, text_col: str = "payload", converters=CONVERTERS) -> DataFrame:
    """Each payload in each converted form (converter, text)."""
    forms = F.array(*[F.struct(F.lit(k).alias("converter"), f(F.col(text_col)).alias("text")) for k, f in converters.items()])
    return payloads.withColumn("form", F.explode(forms)).select("*", "form.converter", "form.text").drop("form")


def converter_matrix(scanned: DataFrame) -> DataFrame:
    """AG-11: caught and total payloads for each converter."""
    return scanned.groupBy("converter").agg(F.count_if(F.size("findings") > 0).alias("caught"), F.count("*").alias("total"))
