"""The corpus pipeline: toxicity, near duplicates, benchmark passages, source mix, token output.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of documents,
but the last, which returns a row for each document written. Stages write their result
to the shared folder, and the next one reads it. Executors give the memory of the stage
before back when one begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwarden.llm.decontamination import bounded, contaminated
from spanwarden.llm.mixing import mix
from spanwarden.llm.near_dedup import near_dedup
from spanwarden.llm.queries import word_tokenizer
from spanwarden.llm.token_output import token_output
from spanwarden.llm.toxicity import without_toxic
from spanwarden.llm.workers import settle
from spanwarden.session import stored, table


#: Encoded pieces that a worker of the last stage keeps; executors hold what earlier stages left beside them.
KEPT_PIECES = 100_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3."""
    settle(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def row_key() -> Column:
    """A row's doc_id; without one, a number from 2**62 on that is a hash of text and source."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    own = F.xxhash64(text, source, text.isNull(), source.isNull())
    return F.coalesce(F.col("doc_id").cast("long"), own.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Five-word shingles, similarity 0.8. Of rows that repeat a doc_id one stays. A row
    without one is judged by ``row_key``: it goes where its group has a doc_id, and of a
    group without any one row stays. Such rows without words are in no group, and all stay.
    """
    settle(spark)
    keyed = docs.withColumn("_key", row_key())
    found = stored(near_dedup(keyed, k=5, percent=80, id_col="_key").select(F.col("_key").alias("_id"), "kept", "n_shingles"), "pipeline-kept")
    gone = stored(found.filter(~F.col("kept")).select("_id").distinct(), "pipeline-gone")
    left = keyed.join(bounded(gone), F.col("_key") == F.col("_id"), "left_anti")
    again = stored(found.filter("kept").groupBy("_id").agg(F.count("*").alias("count"), F.max("n_shingles").alias("_n")).filter("count > 1").select("_id", "_n"), "pipeline-again")
    if not again.head(1):
        return left.select(*docs.columns)
    repeats = (F.col("_key") == F.col("_id")) & (F.col("doc_id").isNotNull() | (F.col("_n") > 0))
    once = left.join(bounded(again), repeats, "left_semi").dropDuplicates(["_key"])
    return left.join(bounded(again), repeats, "left_anti").unionByName(once).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, with a doc_id or not, that hold less than 0.8 of the shingles of every benchmark item."""
    settle(spark)
    keyed = docs.withColumn("_key", row_key())
    hits = contaminated(keyed, table(spark, sf_dir, "benchmark"), k=5, containment=0.8, id_col="_key")
    gone = stored(hits.select(F.col("_key").alias("_id")).distinct(), "pipeline-gone")
    return keyed.join(bounded(gone), F.col("_key") == F.col("_id"), "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, with a doc_id or not, as often as the mix takes it: not at all, once or twice.

    Rows that repeat a doc_id are taken as often as the most taken of them, as are rows
    without one that agree in text and source.
    """
    settle(spark)
    keyed = docs.withColumn("_key", row_key())
    times = stored(mix(keyed, id_col="_key").filter("times > 0").groupBy(F.col("_key").alias("_id")).agg(F.max("times").cast("int").alias("_times")), "pipeline-times")
    chosen = keyed.join(bounded(times), F.col("_key") == F.col("_id"))
    return chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def token_output_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token shards and reads them back: a row for each document."""
    settle(spark)
    return token_output(docs, word_tokenizer(), end_id=1, kept=KEPT_PIECES)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_output_stage),
]

#: Learned scores and library tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
