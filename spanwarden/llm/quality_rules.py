"""Quality rules: a decision list learned from labelled statistics of texts.

Statistics and verdicts are Spark expressions throughout; the driver only learns the
list, from a bounded number of rows of statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwarden.session import stored

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: What the rules may compare, in order of preference among equal rules.
FEATURES = ("n_words", "mean_word", "symbols_a_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "mark_share", "words_a_line")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the counts and ratios of each text; native expressions, no shuffle.

    A null text has no words; ratios without a denominator are 0.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("trimmed", F.btrim("text", F.lit(BLANKS)))
    df = df.withColumn("words", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", SPACE)))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.withColumns({"n_words": F.size("words").cast("long"), "lines": lines})
    windows = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
    df = df.withColumn("windows", windows)
    # only texts with a repeated window are sorted
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("sorted", F.when(repeated, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = F.filter("sorted", lambda x, k: (F.get("sorted", k - 1)["h"] == x["h"]) | (F.get("sorted", k + 1)["h"] == x["h"]))
    df = df.withColumn("places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("places", lambda v, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1), v + 3) - v)), F.lit(0), lambda a, x: a + x)
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    df = df.select(
        "id",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"\d").alias("n_digits"),
        count(r"[!?.,;:]").alias("n_marks"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    ratios = {"mean_word": ("word_chars", "n_words"), "symbols_a_word": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "distinct_share": ("n_distinct", "n_words"), "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"), "mark_share": ("n_marks", "n_words"), "words_a_line": ("n_words", "n_lines")}
    return df.withColumns({k: share(*v) for k, v in ratios.items()}).drop("n_lines", "n_distinct", "n_upper", "n_digits", "n_marks")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.threshold) if self.above else F.col(self.feature) <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _thresholds(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Midpoints between values of each feature, ``most`` at most, taken at quantiles."""
    out = []
    for k in range(x.shape[1]):
        v = np.unique(x[:, k])
        if len(v) > most:
            v = np.unique(np.quantile(x[:, k], np.linspace(0, 1, most)))
        out.append((v[1:] + v[:-1]) / 2)
    return out


def grow(x: np.ndarray, bad: np.ndarray, most: int = 4, cuts: int = 64) -> Rule:
    """Adds the condition with the largest information gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most and (~bad[inside]).any():
        xs, b = x[inside], bad[inside]
        p0, best, found = b.sum(), 1e-9, None
        base = math.log2(max(p0, 1e-9) / len(b))
        for k, cut in enumerate(_thresholds(xs, cuts)):
            if not len(cut):
                continue
            at = np.searchsorted(cut, xs[:, k], "left")  # rows above cut j are those with at > j
            pos = np.bincount(at, weights=b, minlength=len(cut) + 1)[::-1].cumsum()[::-1][1:]
            every = np.bincount(at, minlength=len(cut) + 1)[::-1].cumsum()[::-1][1:]
            for above, p, n in ((True, pos, every), (False, p0 - pos, len(b) - every)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(n, 1)) - base), -1.0)
                j = int(gain.argmax())
                if gain[j] > best:
                    best, found = gain[j], Condition(FEATURES[k], above, float(cut[j]))
        if found is None:
            break
        rule.append(found)
        inside &= found.holds(x)
    return tuple(rule)


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest beginning of ``rule`` with the best (p - n) / (p + n) on other rows."""
    worth = []
    for k in range(1, len(rule) + 1):
        hit = covers(rule[:k], x)
        p, n = bad[hit].sum(), (~bad[hit]).sum()
        worth.append(((p - n) / (p + n) if p + n else -1.0, -k))
    return rule[: -max(worth)[1]] if worth else rule


def learn_rules(x: np.ndarray, bad: np.ndarray, hold: np.ndarray, least_precision: float = 0.8, least_rows: int = 3, most_rules: int = 16) -> list[Rule]:
    """Sequential covering: rules for ``bad`` rows, each grown on rows outside ``hold`` and pruned on those in it.

    A rule is taken if it is right on ``least_precision`` of what it covers, over all rows
    and over the pruning rows, and covers ``least_rows``; its rows are then set aside.
    """
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and bad[left & ~hold].sum() >= least_rows:
        rule = grow(x[left & ~hold], bad[left & ~hold])
        if not rule:
            break
        rule = prune(rule, x[left & hold], bad[left & hold]) if bad[left & hold].any() else rule
        hit = covers(rule, x) & left
        right = lambda rows: bad[rows].mean() if rows.any() else 1.0
        if hit.sum() < least_rows or right(hit) < least_precision or right(hit & hold) < least_precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit_rules(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", most_rows: int = 20_000) -> list[Rule]:
    """Learns from about ``most_rows`` labelled rows of statistics, picked by a hash of the id.

    Label 0 is bad. An id with both labels counts as bad. Rows whose id's crc32 modulo 4 is
    2 are left out, so that the list can be tested on them.
    """
    one = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality"))
    n = one.count()
    if not n:
        return []
    one = one.filter((F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2) & (F.pmod(F.xxhash64("id", F.lit(37)), F.lit(1 << 20)) < min(1.0, most_rows / n) * (1 << 20)))
    rows = statistics.join(one, "id").select((F.pmod(F.xxhash64("id", F.lit(41)), F.lit(3)) == 0).alias("hold"), (F.col("quality") == 0).alias("bad"), *FEATURES).orderBy("hold", "bad", *FEATURES).collect()
    if not rows:
        return []
    x = np.array([r[2:] for r in rows], float)
    return learn_rules(x, np.array([r["bad"] for r in rows]), np.array([r["hold"] for r in rows]))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does. An ordered conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        met = rule[0].column()
        for c in rule[1:]:
            met &= c.column()
        out = (F if out is None else out).when(met, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def base_failed(least_words: int = 50, most_repeat: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the five base counts, base_failed, kept and rule (number of the deciding rule, 0: none) of each row.

    Statistics are written once to the shared folder, so texts are read once. kept is
    false where a base rule fails or a learned rule holds. A null text has no words and
    fails. Repeated rows are judged one by one; without labels only the base rules hold.
    Other columns, whatever their names, are not read.
    """
    statistics = stored(text_statistics(docs, id_col, text_col), "quality-statistics")
    rules = fit_rules(statistics, labels, id_col)
    judged = statistics.withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
