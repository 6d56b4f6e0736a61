"""Upserts with a time to live, kept in state: a key's last write lives until the next write or the end of its time.

Keys are kept in shares, a share's live writes packed into one value, so a micro-batch costs one read, one write and one
timer a share and not one a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from nearlabel.streaming.standing import PAIRS, part, state_store

#: Times are microseconds since 1970.
VERSIONS = "key long, version long, value string, at long, gone long"
#: Shares of the keys: keys of the state.
SHARES = 256
#: Null keys and versions travel as the least long.
LEAST = -(1 << 63)
_LIVE = pa.schema([("key", pa.int64()), ("version", pa.int64()), ("value", pa.string()), ("at", pa.int64())])


def settled(line: pd.DataFrame, ttl: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Of writes (key, version, value, at): those that another of their key follows, with the time at which they are gone,
    and the last one of each key."""
    line = line.sort_values(["key", "at", "version"], kind="stable", ignore_index=True)
    key, at = line["key"].to_numpy(), line["at"].to_numpy()
    last = np.append(key[1:] != key[:-1], True)[: len(line)]
    gone = np.minimum(np.append(at[1:], 0)[: len(line)], at + ttl)
    return line.assign(gone=gone)[~last], line[last]


def pack(live: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _LIVE) as out:
        out.write_table(pa.Table.from_pandas(live, _LIVE, preserve_index=False))
    return sink.getvalue().to_pybytes()


def unpack(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


class Expiring(StatefulProcessor):
    """The live writes of a share of the keys. A write closes the one of its key before it; a timer, set to the first end in
    the share, closes those that none follows."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.live = handle, handle.getValueState("live", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [unpack(self.live.get()[0]).to_pandas()] if self.live.exists() else []
        over, live = settled(pd.concat([*held, *[some[_LIVE.names] for some in rows]]), self.ttl)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self._keep(live)
        yield from versions(over)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = unpack(self.live.get()[0]).to_pandas() if self.live.exists() else pd.DataFrame(columns=_LIVE.names)
        held = held.assign(gone=held["at"] + self.ttl)
        over = held["gone"] <= timerValues.getCurrentWatermarkInMs() * 1000
        self._keep(held[~over])
        yield from versions(held[over])

    def _keep(self, live: pd.DataFrame) -> None:
        if len(live):
            self.live.update((pack(live),))
            self.handle.registerTimer(-(-(int(live["at"].min()) + self.ttl) // 1000))
        else:
            self.live.clear()

    def close(self) -> None:
        pass


def versions(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """VERSIONS, so many at once as may leave a task."""
    out = rows[[*_LIVE.names, "gone"]].astype({"key": "int64", "version": "int64", "at": "int64", "gone": "int64"})
    for lo in range(0, max(1, len(out)), PAIRS):
        yield out.iloc[lo : lo + PAIRS]


def closed(writes: DataFrame, ttl: int, late: str = "1 minute") -> DataFrame:
    """VERSIONS that are over, of a stream of writes (key, version, value, ts), ``ttl`` in seconds. Writes at one time go by
    version. Writes that come more than ``late`` after their time are dropped."""
    timed = writes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    known = lambda x: F.coalesce(F.col(x), F.lit(LEAST)).alias(x)
    rows = timed.select(known("key"), known("version"), "value", "ts", F.unix_micros("ts").alias("at"))
    keyed = rows.withColumn("share", part(F.xxhash64("key"), SHARES)).groupBy("share")
    return _named(keyed.transformWithStateInPandas(Expiring(ttl * 1_000_000), VERSIONS, "Append", "EventTime"))


def _named(rows: DataFrame) -> DataFrame:
    null = lambda x: F.nullif(F.col(x), F.lit(LEAST)).alias(x)
    return rows.select(null("key"), null("version"), "value", "at", "gone")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in batch.column(0):
            yield from unpack(rows.as_buffer()).to_batches()


def open_(spark: SparkSession, checkpoint: str, ttl: int) -> DataFrame:
    """VERSIONS that live still, from the state under a checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", "live").load(checkpoint).select("value.rows")
    live = state.mapInArrow(_unpacked, "key long, version long, value string, at long")
    return _named(live.withColumn("gone", F.col("at") + ttl * 1_000_000))


def run(writes: DataFrame, path: str, ttl: int) -> None:
    """What is there now, to files under ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/closed/batch={number}")

    with state_store(writes.sparkSession):
        closed(writes, ttl).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def live(spark: SparkSession, path: str, ttl: int, at: Column) -> DataFrame:
    """(key, version, value) that live at a time (microseconds), of all that has come so far."""
    over = spark.read.schema(VERSIONS).option("recursiveFileLookup", "true").parquet(f"{path}/closed")
    both = over.unionByName(open_(spark, f"{path}/checkpoint", ttl))
    return both.filter((F.col("at") <= at) & (F.col("gone") > at)).select("key", "version", "value")
