"""Structured Streaming: running statistics, dictionary growth, archive, upserts, supervised restart."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearlabel.sources import io


def source(spark: SparkSession, path: str, schema: str, fmt: str = "json", files: int = 1) -> DataFrame:
    """A directory as a stream of micro-batches; offsets in the checkpoint make a failed batch run again."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).load(path)


def running_count(stream: DataFrame) -> DataFrame:
    return stream.groupBy().agg(F.count(F.lit(1)).alias("d"))


def running_freq(tokens: DataFrame) -> DataFrame:
    """df by token of a stream of (doc_id, token), tokens distinct in each document."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def merge_positions(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: gives new tokens the next positions, in the order of (first, token), and stores them under the
    batch's number, so that a repeated batch overwrites its own rows. Batches have (token, seq)."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("token").agg(F.min("seq").alias("first"))
        known = None
        try:
            known = spark.read.schema("token string, position bigint, first bigint, part bigint").parquet(path).filter(F.col("part") < number)
        except Exception as e:  # noqa: BLE001  the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        start = 0
        if known is not None:
            new = new.join(known.select("token"), "token", "left_anti")
            start = known.count()
        from nearlabel.operators.dictionary import first_seen

        placed = first_seen(new.select("token", F.col("first").alias("seq")), "seq").withColumn("position", F.col("position") + start)
        placed.select("token", "position", "first").write.mode("overwrite").parquet(f"{path}/part={number}")

    return merge


def archive(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", available: bool = False) -> StreamingQuery:
    """Hourly partitions, every ten seconds; ``available``: what is there now, and then the end."""
    writer = io.with_hour(stream, ts).writeStream.partitionBy("dt_hour").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available else writer.trigger(processingTime="10 seconds")).start()


def upsert_into(path: str, key: str, version: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the table of batch n is that of batch n - 1 with last writes; both stay until the next."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch
        if number > 0:
            rows = batch.sparkSession.read.parquet(f"{path}/v{number - 1}").unionByName(batch)
        io.dedupe_latest(rows, key, version).write.mode("overwrite").parquet(f"{path}/v{number}")

    return merge


def supervised(start: Callable[[], StreamingQuery], attempts: int = 10, wait: float = 1.0, most: float = 360.0) -> StreamingQuery:
    """Run a query until it ends well; after an error wait, twice as long each time up to ``most`` seconds, and start it
    again from its checkpoint."""
    for k in range(attempts):
        query = start()
        try:
            query.awaitTermination()
            return query
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(min(most, wait))
            wait *= 2
    raise ValueError("attempts must be positive")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All available input to files under ``path``, and these rows: in mode ``append`` those of all batches, in mode
    ``complete`` those of the last one. A repeated batch overwrites its own folder."""
    schema, spark = stream.schema, stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last[0] = number

    last = [-1]
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(path if mode == "append" else f"{path}/batch={last[0]}")
    return rows.select(*schema.names)
