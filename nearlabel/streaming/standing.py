"""A standing index: bounded buckets and document vectors in state, filled by inserts and asked by requests.

Two streams keep it. The first holds the buckets: rows (seq, id, inserts, asks, tbl, bucket) come in micro-batches, and
whoever asks gets what its bucket held just before its ``seq``. Buckets of a table are kept in groups, a group's queues
packed into one value, so a micro-batch costs one read and one write a group and not one a bucket. The second holds a
vector a document and answers a request's candidates with their cosines. A request therefore reads the groups and the
documents that it meets, never the corpus. Both states have checkpoints in the shared folder: a stream that stops, or an
executor that is lost, goes on from the last complete batch. The stream of buckets can also be read as a table
(``buckets``), for probes without a stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from nearlabel.operators import chunks, lsh
from nearlabel.operators.lsh import Params

#: Groups of buckets a table, and shares of the documents: keys of the states.
GROUPS, SHARES = 16, 64
#: Pairs that leave a task at once.
PAIRS = 1 << 17

ARRIVALS = "seq long, id long, inserts boolean, asks boolean, tbl int, bucket int"
WANTED = "doc_id long, query_id long, n long, pos array<long>, w array<double>"


def met(held_bucket: np.ndarray, held_id: np.ndarray, rows: pd.DataFrame, capacity: int) -> tuple[np.ndarray, ...]:
    """What bounded queues answer and hold: for rows (seq, id, inserts, asks, bucket), in order of seq, the numbers of the
    rows that ask with what they meet, then buckets and ids that are held after them, each bucket's oldest first."""
    rows = rows.sort_values(["seq", "id"], kind="stable")
    asks, inserts = rows["asks"].to_numpy(bool), rows["inserts"].to_numpy(bool)
    bucket, ids = rows["bucket"].to_numpy(np.int64), rows["id"].to_numpy(np.int64)
    line_bucket, line_id = np.concatenate([held_bucket, bucket[inserts]]), np.concatenate([held_id, ids[inserts]])
    # a place in the line: all that is held comes before what is inserted, that before a row comes before it
    place = np.concatenate([np.full(len(held_bucket), -1), np.nonzero(inserts)[0]])
    order = np.lexsort((np.arange(len(place)), line_bucket))
    line_bucket, line_id, place = line_bucket[order], line_id[order], place[order]
    step = len(rows) + 2
    key = line_bucket * step + place + 1
    at = np.nonzero(asks)[0]
    end = np.searchsorted(key, bucket[at] * step + at + 1, "left")
    first = np.maximum(np.searchsorted(line_bucket, bucket[at], "left"), end - capacity)
    times = end - first
    asker = np.repeat(at, times)
    found = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    last = np.searchsorted(line_bucket, line_bucket, "right") - np.arange(len(line_bucket)) <= capacity
    return ids[asker], line_id[found], line_bucket[last], line_id[last]


class Buckets(StatefulProcessor):
    """First-in-first-out queues of a group of buckets of one table, keyed by (tbl, part)."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "bucket binary, id binary")  # int32 and int64, in order of bucket and age

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.held.get() if self.held.exists() else (b"", b"")
        asker, found, bucket, ids = met(np.frombuffer(before[0], np.int32).astype(np.int64), np.frombuffer(before[1], np.int64), pd.concat(list(rows)), self.capacity)
        self.held.update((bucket.astype(np.int32).tobytes(), ids.astype(np.int64).tobytes()))
        for lo in range(0, max(1, len(asker)), PAIRS):
            yield pd.DataFrame({"query_id": asker[lo : lo + PAIRS], "cand_id": found[lo : lo + PAIRS], "tbl": np.int32(key[0])})

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which processors with several variables need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def part(bucket: Column, groups: int = GROUPS) -> Column:
    return F.pmod(bucket, F.lit(groups)).cast("int")


def candidates(arrivals: DataFrame, p: Params) -> DataFrame:
    """(query_id, cand_id, tbl) of a stream of ARRIVALS. Needs the RocksDB state store."""
    keyed = arrivals.withColumn("part", part(F.col("bucket"))).groupBy("tbl", "part")
    return keyed.transformWithStateInPandas(Buckets(p.capacity), "query_id long, cand_id long, tbl int", "Append", "None")


def buckets(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(tbl, bucket, doc_id, age) held by the state under a checkpoint, read as a table: at most ``capacity`` rows a
    bucket, however many documents went through it. age: from 1, the latest."""
    state = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    return state.select("key.tbl", "value.bucket", "value.id").mapInArrow(_held, "tbl int, bucket int, doc_id long, age int")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tbl, buckets, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            bucket = np.frombuffer(buckets, np.int32)
            age = np.searchsorted(bucket, bucket, "right") - np.arange(len(bucket))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), tbl, np.int32)), pa.array(bucket), pa.array(np.frombuffer(ids, np.int64)), pa.array(age.astype(np.int32))], names=["tbl", "bucket", "doc_id", "age"])


class Vectors(StatefulProcessor):
    """A sparse vector a document, keyed by a share of the documents. Rows with a query id ask for its cosine with a
    document's, others put the vector; what one micro-batch puts is there for what it asks."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "doc_id long", "pos binary, w binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        asked = []
        for some in rows:
            puts = some["query_id"].isna()
            for r in some[puts].itertuples():
                self.held.updateValue((int(r.doc_id),), (np.asarray(r.pos, np.int64).tobytes(), np.asarray(r.w, np.float64).tobytes()))
            asked.append(some[~puts])
        out = []
        for doc, of in pd.concat(asked).groupby("doc_id", sort=False):
            if self.held.containsKey((int(doc),)):
                pos, w = (np.frombuffer(x, kind) for x, kind in zip(self.held.getValue((int(doc),)), (np.int64, np.float64), strict=True))
                out += [(int(r.query_id), int(doc), int(r.n), cosine(pos, w, np.array(r.pos), np.array(r.w))) for r in of.itertuples()]
        yield pd.DataFrame(out, columns=["query_id", "cand_id", "n", "cos_sim"])

    def close(self) -> None:
        pass


def cosine(pos: np.ndarray, w: np.ndarray, other: np.ndarray, v: np.ndarray) -> float | None:
    """Of sparse vectors, six digits; None where they share no dimension or one has no length."""
    _, i, j = np.intersect1d(pos, other, return_indices=True)
    size = float(np.sqrt((w * w).sum()) * np.sqrt((v * v).sum()))
    return round(float((w[i] * v[j]).sum()) / size, 6) if len(i) and size else None


def cosines(rows: DataFrame) -> DataFrame:
    """(query_id, cand_id, n, cos_sim) of a stream of WANTED, where a null query_id puts a document's vector."""
    keyed = rows.withColumn("share", part(F.xxhash64("doc_id"), SHARES)).groupBy("share")
    return keyed.transformWithStateInPandas(Vectors(), "query_id long, cand_id long, n long, cos_sim double", "Append", "None")


def packed(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, pos, w) arrays from rows (doc_id, pos, w), or from what has them."""
    if "buckets" in vectors.columns:
        return vectors.select(key, "pos", "w")
    pairs = vectors.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("v"))
    return pairs.select(key, F.col("v.pos").alias("pos"), F.col("v.w").alias("w"))


def _signed(vectors: DataFrame, p: Params) -> DataFrame:
    if "buckets" in vectors.columns:
        return chunks.signatures(vectors)
    return lsh.signatures(vectors.select("doc_id", "pos", F.round(F.col("w") * 1_000_000).cast("bigint").alias("q")), p)


class Standing:
    """The index under a path of the shared folder. ``insert`` and ``ask`` lay arrivals down, ``advance`` lets the streams
    take them, each call one micro-batch of each; ``answers`` are all so far.

    Vectors are rows (doc_id, pos, w), or packed as ``chunks.vectors`` gives them, with weights from a dictionary that the
    caller keeps. A request sees the documents
    of an earlier ``seq``; requests and documents without weights meet nothing. A document that comes again goes into its
    buckets again, its vector is replaced.
    """

    def __init__(self, spark: SparkSession, path: str, p: Params | None = None):
        self.spark, self.path, self.p = spark, path.rstrip("/"), p or Params()

    def _found(self, pattern: str) -> int:
        """How many paths match."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        return len(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or [])

    def _asked(self) -> str:
        """Where the vectors of requests lie that no complete batch has answered: a folder for every number of complete
        batches, so a service that starts again finds what it left."""
        return f"asked/batches={self._found('buckets/commits/[0-9]*')}"

    def _arrive(self, vectors: DataFrame, seq: Column, inserts: bool) -> None:
        sigs = _signed(vectors, self.p)
        rows = sigs.select(seq.cast("long").alias("seq"), F.col("doc_id").alias("id"), F.lit(inserts).alias("inserts"), F.lit(not inserts).alias("asks"), "tbl", "bucket")
        rows.write.mode("append").parquet(f"{self.path}/arrivals")

    def insert(self, vectors: DataFrame, seq: Column) -> None:
        """Documents, with their vectors for those who will ask."""
        self.fill(vectors, seq)
        puts = packed(vectors).select("doc_id", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("long").alias("n"), "pos", "w")
        puts.write.mode("append").parquet(f"{self.path}/wanted/put")

    def fill(self, vectors: DataFrame, seq: Column) -> None:
        """Documents for the buckets alone, which is what probes read."""
        self._arrive(vectors, seq, True)

    def ask(self, vectors: DataFrame, seq: Column) -> None:
        """Questions (doc_id as their id), with their vectors for the candidates that they will get."""
        packed(vectors).withColumnRenamed("doc_id", "query_id").write.mode("append").parquet(f"{self.path}/{self._asked()}")
        self._arrive(vectors, seq, False)

    def advance(self) -> None:
        """One micro-batch of each stream over what was laid down since the last one. A batch that fails runs again from
        the checkpoints and overwrites its own files."""
        p, path, asked, spark = self.p, self.path, self._asked(), self.spark
        any_asked = self._found(asked)

        def narrowed(batch: DataFrame, number: int) -> None:
            if not any_asked:
                batch.write.format("noop").mode("overwrite").save()
                return
            near = lsh.top_n(lsh.collisions(batch), p.top_candidates, "n").drop("rank")
            own = spark.read.parquet(f"{path}/{asked}")
            near.join(own, "query_id").select(F.col("cand_id").alias("doc_id"), "query_id", "n", "pos", "w").write.mode("overwrite").parquet(f"{path}/wanted/asked/batch={number}")

        def kept(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/answers/batch={number}")

        arrivals = spark.readStream.schema(ARRIVALS).parquet(f"{path}/arrivals")
        self._run(candidates(arrivals, p), narrowed, "buckets")
        if not self._found("wanted"):  # buckets that were filled alone
            return
        wanted = spark.readStream.schema(WANTED).option("recursiveFileLookup", "true").parquet(f"{path}/wanted")
        self._run(cosines(wanted), kept, "vectors")

    def _run(self, rows: DataFrame, write, name: str) -> None:
        with state_store(self.spark):
            rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{self.path}/{name}").trigger(availableNow=True).start().awaitTermination()

    def answers(self) -> DataFrame:
        """(query_id, rank, cand_id, n, cos_sim): the ``top_k`` above ``min_sim`` of every request so far."""
        rows = self.spark.read.schema("query_id long, cand_id long, n long, cos_sim double").option("recursiveFileLookup", "true").parquet(f"{self.path}/answers")
        return lsh.top_n(rows.filter(F.col("cos_sim") > self.p.min_sim), self.p.top_k, "cos_sim").select("query_id", "rank", "cand_id", "n", "cos_sim")

    def probe(self, sigs: DataFrame) -> DataFrame:
        """(query_id, cand_id, tbl) for signatures (query_id, tbl, bucket), from the buckets as they are now."""
        held = buckets(self.spark, f"{self.path}/buckets").select(F.col("doc_id").alias("cand_id"), "tbl", "bucket")
        return sigs.join(held, ["tbl", "bucket"]).select("query_id", "cand_id", "tbl")
