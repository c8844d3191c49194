"""Registered values and canaries: exact search, and redaction that they take precedence in."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ENTRIES, LONGEST_PATTERN = 10_000, 500
#: Characters of an anchor: values are found by a hash join on their first characters.
ANCHOR = 8
#: Values up to which each is searched for in every text.
FEW = 256


def check_entry(name: str, value: str | None, pattern: str | None, n: int) -> None:
    if n >= MOST_ENTRIES:
        raise ValueError("registry limit reached")
    if pattern and len(pattern) > LONGEST_PATTERN:
        raise ValueError("pattern too long")
    if pattern and re.search(r"\([^)]*[+*][^)]*\)[+*]", pattern):
        raise ValueError("pattern may need catastrophic backtracking")


def contained(texts: DataFrame, values: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """JN-04, DT-12, DT-13: (key, name, start, end) of every place of a registered value (name, value), overlaps included.

    Every position's first ANCHOR characters meet the values' by a hash join, and the rest
    is compared; values shorter than that are searched for one by one. The registry has
    at most MOST_ENTRIES rows, so it is broadcast.
    """
    if values.count() <= FEW:
        return _places(texts.join(F.broadcast(values.filter(F.length("value") > 0)), F.expr(f"contains({text_col}, value)")), key, text_col)
    long = values.filter(F.length("value") >= ANCHOR).withColumn("anchor", F.substring("value", 1, ANCHOR))
    # blocks first: a substring of a long text walks it from its start
    size = 1024
    starts = F.sequence(F.lit(0), F.floor(F.length(text_col) / size).cast("int"))
    block = F.explode_outer(F.transform(starts, lambda i: F.struct((i * size).alias("at"), F.substring(F.col(text_col), i * size + 1, F.lit(size + ANCHOR - 1)).alias("part"))))
    parts = texts.select(key, block.alias("b")).select(key, "b.at", "b.part")
    wanted = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.lit(size - 1), F.length("part") - ANCHOR))), lambda i: F.substring(F.col("part"), i + 1, F.lit(ANCHOR)))
    anchors = F.broadcast(long.select("anchor").distinct())
    at = parts.select(key, "at", F.posexplode_outer(wanted).alias("i", "anchor")).join(anchors, "anchor", "left_semi").select(key, (F.col("at") + F.col("i")).alias("start"), "anchor")
    found = at.join(F.broadcast(long), "anchor").join(texts.select(key, text_col), key)
    hit = found.filter(F.expr(f"substring({text_col}, start + 1, length(value)) = value")).select(key, "name", "start", (F.col("start") + F.length("value")).alias("end"))
    short = texts.join(F.broadcast(values.filter((F.length("value") < ANCHOR) & (F.length("value") > 0))), F.expr(f"contains({text_col}, value)"))
    return hit.unionByName(_places(short, key, text_col))


def _places(met: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, name, start, end) from rows of texts with a value that they contain."""
    every = F.filter(F.sequence(F.lit(0), F.length(text_col) - F.length("value")), lambda i: F.substring(F.col(text_col), i + 1, F.length("value")) == F.col("value"))
    return met.select(key, "name", "value", F.explode_outer(every).alias("start")).select(key, "name", "start", (F.col("start") + F.length("value")).alias("end"))


def redact_values(text: Column, values: list[tuple[str, str]]) -> Column:
    """FN-04: registered values replaced by their placeholders, longest first."""
    for name, value in sorted(values, key=lambda x: (-len(x[1]), x[0])):
        text = F.replace(text, F.lit(value), F.lit(f"[REDACTED:{name}]"))
    return text
