"""The driver's queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearlabel.llm import decontaminate, fragment_join, oracles, packing, perspectives, quality_rules, rans, rolling_median, secrets, token_counts, toxicity, vector_codes, voronoi_knn, wrappers
from nearlabel.llm.pieces import vocabulary
from nearlabel.session import scratch_dir, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


#: Instruction data: few answers a sequence, and no more than a part of it bears loss.
DIALOGUES = packing.Limits(tokens=4096, segments=8, loss=2560)


def pack_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 on instruction data: every answer of the conversations, after the message before it as its prompt, in
    sequences that all three limits bound. doc_id: conversation and turn. A question meets its answer by conversation and
    turn, so a conversation with many messages is no group."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").distinct()
    asked = c.filter("role <> 'assistant'").groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min(F.coalesce("text", F.lit(""))).alias("asked"))
    answers = c.filter("role = 'assistant'").join(asked, ["conv_id", "turn"], "left").withColumn("prompt", F.coalesce(F.concat("asked", F.lit("\n")), F.lit("")))
    rows = answers.select((F.col("conv_id") * (1 << 20) + F.col("turn")).alias("doc_id"), "prompt", F.concat("prompt", F.coalesce("text", F.lit(""))).alias("text"))
    packed = packing.pack_documents(rows, vocabulary("word_bpe_49k.json"), limits=DIALOGUES, prompt="prompt")
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op2_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_dir(spark, "rans")
    rans.write_ids(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), out)
    return rans.read_ids(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    scored = toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), labels.filter(~held_out("doc_id")).select("doc_id", "toxic"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", F.to_json("evidence").alias("evidence"))


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op5_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = wrappers.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


def op6_fragment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragment_join.near_duplicates(table(spark, sf_dir, "documents"), n=3, num=90)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", secrets.find_secrets(F.col("text")).alias("found"))
    base = [r.kind for r in secrets.BASE_RULES]
    return documents.select(
        "doc_id",
        *[secrets.count_of(F.col("found"), kind).alias(f"n_{kind}") for kind in base],
        F.sha2(secrets.joined(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        secrets.joined(F.col("found")).alias("spans"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(documents, vocabulary("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return voronoi_knn.knn_join(embeddings, embeddings.filter(F.col("vec_id") % 50 == 0), work=scratch_dir(spark, "knn"))


def op11_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality_rules.judged(table(spark, sf_dir, "documents"), counts).select("doc_id", *counts, "base_failed", "kept")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_median.rolling(table(spark, sf_dir, "clicks"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "pack_dialogues": pack_dialogues,
        "op2_rans": op2_rans,
        "op3_toxicity": op3_toxicity,
        "op4_perspectives": op4_perspectives,
        "op5_wrappers": op5_wrappers,
        "op6_fragment_join": op6_fragment_join,
        "op7_secrets": op7_secrets,
        "op8_decontaminate": op8_decontaminate,
        "op9_token_counts": op9_token_counts,
        "op10_voronoi_knn": op10_voronoi_knn,
        "op11_quality_cascade": op11_quality_cascade,
        "op12_vector_codes": op12_vector_codes,
        "op13_rolling_median": op13_rolling_median,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
