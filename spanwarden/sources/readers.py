"""Readers with declared schemas, sinks, scenario and probe files, and flattening of nested values."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = "text string, label int, category string, source string, metadata map<string,string>"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """IO-01: samples; fields beyond the schema go to metadata."""
    raw = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("m")).filter("m is not null")
    own = ("text", "label", "category", "source")
    rest = F.map_filter("m", lambda k, v: ~k.isin(*own))
    return raw.select(F.col("m")["text"].alias("text"), F.col("m")["label"].cast("int").alias("label"), F.coalesce(F.col("m")["category"], F.lit("unknown")).alias("category"), F.col("m")["source"].alias("source"), rest.alias("metadata"))


def read_csv(spark: SparkSession, path: str, text: str = "text", label: str = "label", category: str | None = None) -> DataFrame:
    """IO-02."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), (F.col(category) if category else F.lit("unknown")).alias("category"), F.lit(None).cast("string").alias("source"), F.create_map().cast("map<string,string>").alias("metadata"))


def read_parquet(spark: SparkSession, path: str, text: str = "text", label: str = "label", category: str | None = None) -> DataFrame:
    """IO-03: only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), (F.col(category) if category else F.lit("unknown")).alias("category"), F.lit(None).cast("string").alias("source"), F.create_map().cast("map<string,string>").alias("metadata"))


def read_auto(spark: SparkSession, path: str, **columns) -> DataFrame:
    """IO-04: by suffix."""
    kind = PurePosixPath(path).suffix.lower()
    if kind in (".jsonl", ".ndjson"):
        return read_jsonl(spark, path)
    reader = {".csv": read_csv, ".parquet": read_parquet}.get(kind)
    if reader is None:
        raise ValueError(f"no reader for {kind or 'a path without suffix'}")
    return reader(spark, path, **columns)


def write_jsonl(df: DataFrame, path: str) -> None:
    """IO-05."""
    df.write.json(path)


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """IO-09: one JSON array in a file."""
    return spark.read.option("multiLine", True).json(path)


def read_scenarios(spark: SparkSession, text: str) -> DataFrame:
    """IO-08: ordered steps of a scenario in YAML or JSON, with expectations as JSON."""
    try:
        import yaml

        told = yaml.safe_load(text)
    except ImportError:
        told = json.loads(text)
    steps = told if isinstance(told, dict) else {"steps": told}
    rows = [(steps.get("name"), str(steps.get("session_id") or steps.get("name")), i, s.get("action"), s.get("text"), s.get("source") or "user", s.get("tool_name"), json.dumps(s.get("arguments") or {}), s.get("agent_id"), float(s.get("delay_s") or 0), json.dumps(s.get("expect") or {})) for i, s in enumerate(steps.get("steps") or [])]
    return spark.createDataFrame(rows, "name string, session_id string, seq long, action string, text string, source string, tool_name string, arguments string, agent_id string, delay_s double, expect string")


def read_files(spark: SparkSession, path: str, most_chars: int = 50_000) -> DataFrame:
    """IO-14: whole text files, cut at the scan limit."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.substring("value", 1, most_chars).alias("text"))


def first_by_text(df: DataFrame, order: str) -> DataFrame:
    """IO-07, ST-05: one row for each text, the first by ``order``."""
    cols = [c for c in df.columns if c != "text"]
    return df.groupBy("text").agg(F.min_by(F.struct(*cols), order).alias("_r")).select("text", "_r.*").select(*df.columns)


def leaves(json_col: Column) -> Column:
    """IO-16: the scalar values of nested JSON up to six levels, in order, joined by spaces."""
    return F.array_join(F.regexp_extract_all(json_col, F.lit(r'(?:[:\[,]\s*)(?:"((?:[^"\\]|\\.)*)")(?!\s*:)'), F.lit(1)), " ")


def argument_text(json_col: Column) -> Column:
    """IO-17: top-level values, lower-cased, joined by spaces."""
    return F.lower(F.array_join(F.map_values(F.from_json(json_col, "map<string,string>")), " "))
