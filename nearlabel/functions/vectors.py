"""Vectors as columns: dense arrays, and sparse vectors in long form (doc, pos, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l1_normalize(a: Column) -> Column:
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), total))


def l2_normalize(rows: DataFrame, doc: str = "doc_id", weight: str = "w") -> DataFrame:
    """Sparse rows with every document's weights divided by their Euclidean norm; a zero vector gets nulls."""
    w = Window.partitionBy(doc)
    return rows.withColumn(weight, F.try_divide(F.col(weight), F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(w))))


def norms(rows: DataFrame, doc: str = "doc_id", weight: str = "w") -> DataFrame:
    return rows.groupBy(doc).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("norm"))
