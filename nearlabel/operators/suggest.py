"""Label suggestions from ranked neighbours, and the whole request path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearlabel.operators import chunks, lsh
from nearlabel.operators.graph import cut


def by_neighbours(ranked: DataFrame, strong: float = 0.2, enough: int = 5) -> DataFrame:
    """(query_id, rank, label) from rows (query_id, rank, cos_sim, labels array). A neighbour's labels count if it is at
    least ``strong``, or if no more than ``enough`` labels were suggested before it."""
    rows = ranked.withColumn("labels", F.array_distinct("labels")).withColumn("n", F.size("labels"))
    # a skipped row adds nothing, and once the count is over the limit it stays over it, so running sums of all rows decide
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    use = (F.col("cos_sim") >= strong) | (F.coalesce(F.sum("n").over(w), F.lit(0)) <= enough)
    return rows.withColumn("use", use).filter("use").select("query_id", "rank", F.explode("labels").alias("label"))


def by_search(ranked: DataFrame, enough: int = 5, compat: bool = False) -> DataFrame:
    """(query_id, rank, label): distinct labels by first rank, until more than ``enough`` are found before a row.
    compat: each distinct label list counts once, and its labels may come again with another list."""
    if compat:
        rows = ranked.withColumn("key", F.array_join("labels", ","))
        first = rows.groupBy("query_id", "key").agg(F.min("rank").alias("rank"), F.min_by("labels", "rank").alias("labels"))
    else:
        labels = ranked.select("query_id", "rank", F.explode("labels").alias("label")).groupBy("query_id", "label").agg(F.min("rank").alias("rank"))
        first = labels.groupBy("query_id", "rank").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    counted = first.withColumn("before", F.coalesce(F.sum(F.size("labels")).over(w), F.lit(0)))
    return counted.filter(F.col("before") <= enough).select("query_id", "rank", F.explode("labels").alias("label"))


def neighbours(queries: DataFrame, docs: DataFrame, p: lsh.Params | None = None) -> DataFrame:
    """The request path: (query_id, rank, cand_id, n, cos_sim) for texts (query_id, text) against (doc_id, text).

    Clean, tokenize, weigh by the documents' dictionary, probe the buckets, count collisions, keep ``top_candidates`` by
    count, take the cosine (of six digits), keep ``top_k`` above ``min_sim``. Texts are cleaned once, and stay in chunks; of
    the documents' signatures only those in buckets that somebody asks are moved, of their vectors only the candidates'.
    """
    p = p or lsh.Params()
    packed = chunks.pack(docs, clean=True)
    entries = chunks.entries(packed, docs.select("doc_id"))
    signs = lsh.signs(entries, p)
    dv = chunks.vectors(packed, entries, p, signs)
    qv = chunks.vectors(chunks.pack(queries.withColumnRenamed("query_id", "doc_id"), clean=True), entries, p, signs)
    qs = chunks.signatures(qv).withColumnRenamed("doc_id", "query_id")
    asked = F.broadcast(qs.select("tbl", "bucket").distinct())  # at most all buckets of all tables
    ds = chunks.signatures(dv).join(asked, ["tbl", "bucket"], "left_semi")
    near = cut(lsh.top_n(lsh.collisions(lsh.query_only(qs, ds, p)), p.top_candidates, "n").drop("rank"), "candidates")
    own = chunks.unpacked(dv.join(near.select(F.col("cand_id").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    sims = lsh.sparse_cosine(near, chunks.unpacked(qv).withColumnRenamed("doc_id", "query_id"), own)
    ranked = lsh.top_n(sims.filter(F.col("cos_sim") > p.min_sim), p.top_k, "cos_sim")
    return ranked.join(near, ["query_id", "cand_id"]).select("query_id", "rank", "cand_id", "n", "cos_sim")


def suggest(spark: SparkSession, texts: list[str], labelled: DataFrame, p: lsh.Params | None = None) -> DataFrame:
    """Answers to a few request texts: (query, text, labels, cos_sim), best first; labelled has (doc_id, text, labels)."""
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "query_id long, text string")
    found = neighbours(asked, labelled, p)
    named = found.join(labelled.select(F.col("doc_id").alias("cand_id"), "text", "labels"), "cand_id")
    return named.select("query_id", "rank", "text", "labels", "cos_sim").orderBy("query_id", "rank")


def response(suggested: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, body): the JSON answer with suggested labels and similar texts, both bounded by the ranking."""
    labels = suggested.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("labels"))
    similar = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cand_id", "cos_sim"))).alias("similar"))
    body = F.to_json(F.struct(F.coalesce("labels", F.array().cast("array<string>")).alias("suggestions"), F.col("similar")))
    return similar.join(labels, "query_id", "left").select("query_id", body.alias("body"))
