"""Token counts of whole texts by a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwarden.llm.pieces import encoder


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row.

    Arrow batches go to the workers, which send back lengths only. Within a batch,
    texts form groups of about equal bytes, long texts are split at safe boundaries
    (see :mod:`spanwarden.llm.pieces`), and each distinct piece is encoded once.
    There is no shuffle; memory is bounded by the Arrow batch and the pieces kept.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids are
    counted row by row. Other columns, whatever their names, are not read. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            n = enc.lengths(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    counted = rows.select(rows[0], F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
