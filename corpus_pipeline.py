"""From raw documents to packed training sequences: toxicity, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame; all but
the last return the columns of ``documents``. Rows with a null doc_id are judged like others. Rows that are equal in
doc_id and text are one document from the near duplicates on; rows of one doc_id with different texts are different
documents. Null and empty texts stay, and are packed as an end id alone; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearlabel.llm import decontaminate, fragment_join, packing, secrets
from nearlabel.llm import toxicity as tox
from nearlabel.llm.pieces import vocabulary
from nearlabel.llm.queries import held_out
from nearlabel.operators.graph import Scratch
from nearlabel.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL: the first and the last stage learn and pack; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.7 go. Labels come from the rows that op3 may learn from."""
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    return tox.toxicity(docs, labels.select("doc_id", "toxic")).filter("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of 5-word shingles at 0.8 join, the one of the smallest doc_id stays."""
    return fragment_join.without_duplicates(docs, n=5, num=80).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text become their kind in brackets, and n_chars follows."""
    clean = docs.withColumn("text", secrets.redact(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 4096 ids, one row a piece, with the ids."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("benchmark passages", benchmark_passages),
    ("secret scans", secret_scans),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        before, docs = docs, scratch.cut(out, f"stage-{k}")
        if k:
            scratch.drop(before)
