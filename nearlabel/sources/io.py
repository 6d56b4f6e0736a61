"""Sources and sinks: JSON lines, log envelopes, dictionaries, adjacency lists, archives, upserts, search exports."""

from __future__ import annotations

import configparser
import json
import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearlabel.functions import text as T

#: Message of the queue and of exports. Where stored data has other field names, callers pass a schema of theirs.
MESSAGE = "id string, text string, labels array<string>"


def raw_schema(labels: str = "labels") -> str:
    """Raw objects, as far as their fields are read; ``labels`` is the source's name of the list of label objects."""
    return f"id bigint, id_str string, text string, lang string, created_at string, user struct<screen_name: string>, entities struct<{labels}: array<struct<text: string>>>, coordinates struct<coordinates: array<double>>, delete string, limit string, warning string"


def json_lines(spark: SparkSession, paths: str | list[str], schema: str = MESSAGE) -> DataFrame:
    """JSON-lines files (lists of paths and globs with {a,b} too) with a given schema: no inference pass."""
    return spark.read.schema(schema).json(paths)


def json_maps(lines: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """Each line as a map of its top-level fields to their text, column ``m``; columns to keep go before it."""
    return lines.select(*keep, F.from_json(column, "map<string,string>").alias("m"))


def envelope(lines: DataFrame, schema: str | None = None, column: str = "value") -> DataFrame:
    """``timestamp<TAB>tag<TAB>json`` lines to (ts, tag, body)."""
    parts = F.split(F.col(column), "\t", 3)
    return lines.select(F.get(parts, F.lit(0)).alias("ts"), F.get(parts, F.lit(1)).alias("tag"), F.from_json(F.get(parts, F.lit(2)), schema or raw_schema()).alias("body"))


def scan(df: DataFrame, columns: list[str], limit: int | None = None, order: str | None = None) -> DataFrame:
    """Projection with an optional limit, by an order that makes it repeatable."""
    out = df.select(*columns)
    return out if limit is None else out.orderBy(order or columns[0]).limit(limit)


def variants(spark: SparkSession, path: str) -> DataFrame:
    """A variant dictionary (variant<TAB>normal): the last line of a variant holds. Line numbers come from the file order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    parts = F.split("value", "\t")
    rows = lines.filter(F.size(parts) >= 2).select(F.get(parts, F.lit(0)).alias("variant"), F.get(parts, F.lit(1)).alias("normal"), "line")
    return rows.groupBy("variant").agg(F.max_by("normal", "line").alias("normal"))


def counts_csv(spark: SparkSession, path: str, schema: str = "token string, df bigint") -> DataFrame:
    return spark.read.schema(schema).csv(path)


def jdbc(spark: SparkSession, url: str, dbtable: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load()


def settings(path: str, section: str = "default", environment: str = "NEARLABEL_SETTINGS") -> dict[str, str]:
    """A section of an INI or plain key=value file; the environment variable may name another file."""
    path = os.environ.get(environment, path)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    parser = configparser.ConfigParser()
    parser.read_string(text if text.lstrip().startswith("[") else f"[{section}]\n{text}")
    return dict(parser[section])


def is_valid(raw: DataFrame, lang: str = "en") -> Column:
    """No control object, and text, date and the language are there."""
    controls = [F.col(c).isNull() for c in ("delete", "limit", "warning") if c in raw.columns]
    ok = (F.coalesce(F.col("created_at"), F.lit("")) != "") & (F.coalesce(F.col("text"), F.lit("")) != "") & (F.col("lang") == lang)
    for c in controls:
        ok = ok & c
    return F.coalesce(ok, F.lit(False))


def messages(raw: DataFrame, labels: str = "labels") -> DataFrame:
    """Queue messages of raw objects that carry labels."""
    found = T.label_texts(F.col(f"entities.{labels}"))
    return raw.select(F.col("id").cast("string").alias("id"), "text", found.alias("labels")).filter(F.size("labels") > 0)


def dedupe(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the first by the given order, or any."""
    if not order:
        return df.dropDuplicates([key])
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert(stored: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Last write wins by version; both sides have equal columns."""
    return dedupe_latest(stored.unionByName(new), key, version)


def dedupe_latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    values = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(values, version).alias("_v")).select("_v.*")


def unexpired(rows: DataFrame, written: str, ttl_seconds: int, now: Column) -> DataFrame:
    return rows.filter(F.col(written) + F.make_dt_interval(secs=F.lit(ttl_seconds)) > now)


def with_hour(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Column dt_hour = yyyyMMdd_HH, the archive's partition."""
    return rows.withColumn("dt_hour", F.date_format(ts, "yyyyMMdd_HH"))


def write_archive(rows: DataFrame, path: str, ts: str = "ts") -> None:
    with_hour(rows, ts).write.mode("append").partitionBy("dt_hour").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated text; an output that exists is replaced."""
    df.write.mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_lines(df: DataFrame, labels: str = "labels") -> DataFrame:
    """JSON lines with the labels joined by commas."""
    joined = df.withColumn(labels, F.array_join(labels, ",")) if dict(df.dtypes)[labels].startswith("array") else df
    return joined.select(F.to_json(F.struct(*joined.columns)).alias("value"))


def search_batches(df: DataFrame, key: str, size: int = 1000) -> DataFrame:
    """Documents for a search index, key renamed to id: JSON arrays of about ``size`` documents, dealt by hash."""
    named = df.withColumnRenamed(key, "id")
    batch = F.floor(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(max(1, (1 << 30) // max(1, df.count() // size + 1))))
    body = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("doc")), ","), F.lit("]"))
    return named.select(batch.alias("batch"), F.to_json(F.struct(*named.columns)).alias("doc")).groupBy("batch").agg(body.alias("body"))


def inverted_index(tokens: DataFrame) -> DataFrame:
    """(token, doc_id, tf), to be stored by token."""
    return tokens.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def kv_records(dictionary: DataFrame) -> DataFrame:
    """``<token>:token`` with a map of its fields, as a key-value store holds them."""
    fields = F.create_map(*[x for c in ("df", "idf", "position") if c in dictionary.columns for x in (F.lit(c), F.col(c).cast("string"))])
    return dictionary.select(F.concat("token", F.lit(":token")).alias("key"), fields.alias("fields"))


def show(df: DataFrame, n: int = 20) -> None:
    df.printSchema()
    df.show(n, truncate=False)


def requests(spark: SparkSession, texts: Iterable[str | None]) -> DataFrame:
    """Request texts as rows; none for no or empty text."""
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts) if t], "query_id long, text string")


def request_form(body: str) -> str | None:
    """The text of a request as JSON object {"text": ...} or as plain text."""
    try:
        parsed = json.loads(body)
    except ValueError:
        return body or None
    return parsed.get("text") if isinstance(parsed, dict) else str(parsed)
