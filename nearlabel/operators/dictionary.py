"""Dictionary (token, df, idf, position): batch build, lookups, and its online form by micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearlabel.operators.graph import cut


def exploded(docs: DataFrame, tokens: Column, doc: str = "doc_id") -> DataFrame:
    """(doc_id, token) for every token; empty arrays give no rows."""
    return docs.select(F.col(doc), F.explode(tokens).alias("token"))


def doc_total(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("name"), "n")


def doc_freq(docs: DataFrame, token_set: Column, least: int = 1) -> DataFrame:
    """(token, df) over documents' token sets, tokens of at least ``least`` documents."""
    df = docs.select(F.explode(F.array_distinct(token_set)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.filter(F.col("df") >= least) if least > 1 else df


def last_wins(variants: DataFrame) -> DataFrame:
    """(variant, normal) of a dictionary with line numbers: the last line of a variant holds."""
    return variants.groupBy("variant").agg(F.max_by("normal", "line").alias("normal"))


def normalize(tokens: DataFrame, variants: DataFrame) -> DataFrame:
    """Tokens replaced by their normal form, once. Spark broadcasts the dictionary if its size allows."""
    named = variants.select(F.col("variant").alias("token"), "normal")
    return tokens.join(named, "token", "left").withColumn("token", F.coalesce("normal", "token")).drop("normal")


def merge_variants(df: DataFrame, variants: DataFrame) -> DataFrame:
    """Document frequencies of variants added to their normal forms'; variants get a copy of the normal's record."""
    normals = normalize(df, variants).groupBy("token").agg(F.sum("df").alias("df"))
    copies = variants.join(normals, variants.normal == normals.token).select(F.col("variant").alias("token"), "df")
    return normals.join(variants.select(F.col("variant").alias("token")), "token", "left_anti").union(copies)


def idf(n: Column, df: Column, mode: str = "log_over_df") -> Column:
    """ln(N) / (df + 1), the observable formula; ``log_ratio`` is the textbook's ln(N / (df + 1)), ``log10_over_df``
    the retired one's log10(N) / (df + 1)."""
    if mode == "log_ratio":
        return F.log(n / (df + 1))
    return (F.log10(n) if mode == "log10_over_df" else F.log(n)) / (df + 1)


def positions(tokens: DataFrame) -> DataFrame:
    """(token, position): 0, 1, ... in the order of tokens."""
    return with_rank(tokens.select("token").distinct(), ["token"], "position")


def with_rank(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A gapless rank from 0 in the order of unique keys. Rows are dealt out by range and numbered where they lie; one
    sum a partition gives the offsets, so no task sees all rows (the window has one row a partition)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    ranged = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranks")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col("_part").alias("_own"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), F.col("_part") == F.col("_own")).withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_own", "_at", "_before")


def build(docs: DataFrame, tokens: Column, least: int = 2, mode: str = "log_over_df") -> DataFrame:
    """(token, df, idf, position) of all tokens of at least ``least`` documents."""
    return entries(cut(doc_freq(docs, tokens, least), "df"), docs, mode)


def of_terms(tf: DataFrame, docs: DataFrame, least: int = 2, mode: str = "log_over_df") -> DataFrame:
    """As ``build``, from term frequencies (one row a document and token) of the documents."""
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least)
    return entries(cut(df, "df"), docs, mode)


def entries(df: DataFrame, docs: DataFrame, mode: str) -> DataFrame:
    """(token, df, idf, position) of tokens (token, df) of documents."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return with_rank(df, ["token"], "position").crossJoin(F.broadcast(n)).select("token", "df", idf(F.col("n"), F.col("df"), mode).alias("idf"), "position")


def lookup(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Tokens with df and position of the dictionary; 0 and -1 where it lacks them."""
    met = tokens.join(dictionary.select("token", "df", "position"), "token", "left")
    return met.withColumn("df", F.coalesce("df", F.lit(0))).withColumn("position", F.coalesce("position", F.lit(-1)))


def term_freq(docs: DataFrame, tokens: Column, doc: str = "doc_id") -> DataFrame:
    return exploded(docs, tokens, doc).groupBy(doc, "token").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(tf: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(doc_id, pos, w): w = tf * idf; tokens without a record are skipped."""
    return tf.join(dictionary.select("token", "idf", "position"), "token").select("doc_id", F.col("position").alias("pos"), (F.col("tf") * F.col("idf")).alias("w"))


# Online states: a batch sees counts that include the whole batch.


def running_count(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """Rows with ``d``, the documents up to and including their batch. Batches are dealt out by range and summed where
    they lie; one row a partition gives the offsets, so no task sees all batches."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy(F.col(batch).alias("_batch")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = cut(sizes.repartitionByRange(n, "_batch").withColumn("_part", F.spark_partition_id()), "batches")
    parts = ranged.groupBy(F.col("_part").alias("_own")).agg(F.sum("_n").alias("_all"))
    before = parts.select("_own", (F.sum("_all").over(Window.orderBy("_own")) - F.col("_all")).alias("_before"))
    local = ranged.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_part").orderBy("_batch")))
    upto = local.join(F.broadcast(before), F.col("_part") == F.col("_own")).select("_batch", (F.col("_upto") + F.col("_before")).alias("d"))
    return rows.join(upto, rows[batch].eqNullSafe(F.col("_batch"))).drop("_batch")


def running_freq(tokens: DataFrame, doc: str = "doc_id", batch: str = "batch") -> DataFrame:
    """(token, batch, df): documents with the token up to and including the batch, for batches that hold it. A token's
    window has a row a batch, however many documents hold it. Documents are told apart where a token's batch lies, so
    their rows are moved once."""
    new = tokens.select(batch, doc, "token").repartition("token", batch).distinct().groupBy("token", batch).agg(F.count(F.lit(1)).alias("_n"))
    return new.select("token", batch, F.sum("_n").over(Window.partitionBy("token").orderBy(batch)).alias("df"))


def first_seen(tokens: DataFrame, order: str = "seq") -> DataFrame:
    """(token, position, first): positions in the order of first sight, ties by token. ``first`` is the order value at
    which a token was new; position 0 is like any other."""
    first = tokens.groupBy("token").agg(F.min(order).alias("first"))
    return with_rank(first, ["first", "token"], "position").select("token", "position", "first")


def online_vectors(docs: DataFrame, mode: str = "log10_over_df") -> DataFrame:
    """(doc_id, pos, w, new_words) of documents (doc_id, batch, tokens) that come in batches: tf * idf by the number of
    documents and the document frequencies as of the document's batch, that batch included, at unit length; positions in
    the order of first sight (by doc_id, then token). new_words: tokens that the document is the first to hold.

    The states are joined as of the batch that asks: a token has a row a batch that holds it, so neither join nor window
    of states sees a row a document; documents' rows meet them once. w is null where all weights of a document are 0 (a single document).
    """
    tf = cut(docs.select("doc_id", "batch", F.explode("tokens").alias("token")).groupBy("doc_id", "batch", "token").agg(F.count(F.lit(1)).alias("tf")), "tf")
    sizes = running_count(docs.select("doc_id", "batch")).select("batch", "d").distinct()
    held = cut(tf.groupBy("token", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("seq")), "held")
    upto = F.sum("n").over(Window.partitionBy("token").orderBy("batch"))
    states = held.select("token", "batch", upto.alias("df")).join(first_seen(held), "token").join(sizes, "batch")
    states = states.select("token", "batch", idf(F.col("d"), F.col("df"), mode).alias("idf"), "position", "first")
    rows = tf.join(states, ["token", "batch"])
    rows = rows.select("doc_id", F.col("position").alias("pos"), (F.col("tf") * F.col("idf")).alias("w"), (F.col("first") == F.col("doc_id")).cast("bigint").alias("new"))
    whole = Window.partitionBy("doc_id")
    return rows.select("doc_id", "pos", F.try_divide(F.col("w"), F.sqrt(F.sum(F.col("w") * F.col("w")).over(whole))).alias("w"), F.sum("new").over(whole).alias("new_words"))
