"""The corpus operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanwarden.llm.decontamination import contaminated
from spanwarden.llm.language_id import language_id
from spanwarden.llm.license_scan import license_scan
from spanwarden.llm.mixing import mix
from spanwarden.llm.near_dedup import near_dedup
from spanwarden.llm.quality_rules import quality_rules
from spanwarden.llm.token_counts import token_counts
from spanwarden.llm.token_output import token_output
from spanwarden.llm.toxicity import toxicity
from spanwarden.llm.warc import deduplicated_archives
from spanwarden.session import table


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), word_tokenizer(), end_id=1)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), word_tokenizer(), limit=2048)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_archives(table(spark, sf_dir, "pages")).drop("url")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), k=2)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_language_id, op2_decontamination, op3_token_output, op4_token_counts, op5_license_scan, op6_mixing, op7_toxicity, op8_warc, op9_near_dedup, op10_quality_rules)
    return {f.__name__: f for f in every}


#: Words as the scans take them, and runs of five of them.
_WORDS = r"regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = "list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)])"

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, unnest({_RUNS}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
b AS (SELECT item_id, {_RUNS} AS r FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) >= 5),
u AS (SELECT item_id, len(r) AS n_item, unnest(r) AS s FROM b)
SELECT doc_id, item_id, n_item::BIGINT AS n_item, count(*)::BIGINT AS n_shared, count(*) / n_item AS containment
FROM d JOIN u USING (s) GROUP BY doc_id, item_id, n_item HAVING count(*) / n_item >= 0.8
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": DECONTAMINATION_SQL}
