"""Token counts: lengths only, by an Arrow function over byte-balanced batches (see ``pieces``)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearlabel.llm.pieces import encoder


def count_tokens(text: Column, vocabulary_path: str) -> Column:
    """Number of ids that the vocabulary's library gives for the whole text, without added tokens; null counts 0."""

    @F.arrow_udf("long")
    def counts(texts: pa.Array) -> pa.Array:
        return pa.array(encoder(vocabulary_path).counts(texts.to_pylist()), pa.int64())

    return counts(text)


def token_counts(df: DataFrame, vocabulary_path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """All rows with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) added.

    Null text: 0 bytes and tokens. Columns of these names that exist already are replaced; other columns and repeated
    rows stay. No shuffle: a row is counted where it is read, and only the text goes to Python.
    """
    return (
        df.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
        .withColumn("n_tokens", count_tokens(F.col(text), vocabulary_path))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
