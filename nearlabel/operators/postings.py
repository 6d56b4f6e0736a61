"""Postings: an inverted index as a table of delta-coded blocks that grows by segments, and exact top-n search that reads
only the blocks that can matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearlabel.operators.lsh import top_n
from nearlabel.session import remove

#: Postings of a block.
BLOCK = 128
#: Postings that a search reads at once.
STEP = 32
#: Postings that a shard of the search aims at.
SHARD = 1 << 21
#: Cosines have six digits: bounds may miss a score by that much.
SLACK = 2e-6

BLOCKS = "token string, first long, last long, n int, most long, ids binary, counts binary"


# Codes.


def coded(values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Non-negative integers as bytes of seven bits, low ones first, the eighth set where more follow; one string for each
    run that begins at ``starts``, the first at 0."""
    return strings(values, starts).to_pylist()


def strings(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """As ``coded``, where they lie: no object a string."""
    values = values.astype(np.uint64)
    bits = np.frexp(np.maximum(values, 1).astype(np.float64))[1]  # may be one too many for values of over 53 bits
    size = np.maximum(1, -(-bits // 7))
    row = np.repeat(np.arange(len(values)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out = ((values[row] >> (7 * at).astype(np.uint64)) & np.uint64(127)).astype(np.uint8)
    out[at < size[row] - 1] |= 128
    edges = np.append(np.concatenate([[0], np.cumsum(size)])[starts], len(out)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(out)]).cast(pa.binary())


def joined(binary: pa.Array) -> np.ndarray:
    """The bytes of all strings, one after another."""
    whole = binary.cast(pa.large_binary())
    _, offsets, data = whole.buffers()
    edges = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]]


def decoded(data: bytes | np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.nonzero(raw < 128)[0]
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    at = (np.arange(len(raw)) - np.repeat(first, last - first + 1)).astype(np.uint64)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (np.uint64(7) * at), first).astype(np.int64) if len(last) else np.zeros(0, np.int64)


# The index.


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (token, doc_id, tf) to blocks; a block ends with its token, its batch or after BLOCK postings."""
    for batch in batches:
        if not batch.num_rows:
            continue
        token, ids, tf = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        code = token.dictionary_encode().indices.to_numpy()
        new = np.concatenate([[True], code[1:] != code[:-1]])
        run = np.nonzero(new)[0]
        place = np.arange(len(code)) - np.repeat(run, np.diff(np.append(run, len(code))))
        starts = np.nonzero(place % BLOCK == 0)[0]
        ends = np.append(starts[1:], len(code))
        gaps = np.diff(ids, prepend=0)
        gaps[starts] = 0
        yield pa.RecordBatch.from_arrays(
            [token.take(pa.array(starts)), pa.array(ids[starts]), pa.array(ids[ends - 1]), pa.array((ends - starts).astype(np.int32)), pa.array(np.maximum.reduceat(tf, starts)), strings(gaps, starts), strings(tf, starts)],
            names=["token", "first", "last", "n", "most", "ids", "counts"],
        )


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            n, gaps = part.column("n").to_numpy(), decoded(joined(part.column("ids")))
            upto = np.cumsum(gaps)
            before = part.column("first").to_numpy() - upto[np.cumsum(n) - n]  # a block's first gap is 0
            ids = upto + np.repeat(before, n)
            yield pa.RecordBatch.from_arrays([part.column("token").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(ids), pa.array(decoded(joined(part.column("counts"))))], names=["token", "doc_id", "tf"])


def blocks(postings: DataFrame) -> DataFrame:
    """BLOCKS of rows (token, doc_id, tf). Rows are dealt out by ranges of token and document, so a word that is in every
    document fills many tasks."""
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = postings.select("token", F.col("doc_id").cast("long"), F.col("tf").cast("long")).repartitionByRange(n, "token", "doc_id").sortWithinPartitions("token", "doc_id")
    return ranged.mapInArrow(_encode, BLOCKS)


def postings_of(blocks: DataFrame) -> DataFrame:
    """(token, doc_id, tf) of blocks."""
    return blocks.mapInArrow(_decode, "token string, doc_id long, tf long")


class Index:
    """An inverted index under a path: generations of segments. ``append`` adds a segment to the latest generation,
    ``merge`` writes all of its postings as the one segment of the next. A generation counts once its first segment is
    complete, so a merge that fails leaves the old one, and one that is repeated overwrites what it left.

    Documents of different segments are different; a document in two segments has two postings of a token until a merge,
    which adds their counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _complete(self) -> dict[int, list[str]]:
        """Complete segments by generation; a listing of folders, one a segment."""
        jvm, out = self.spark.sparkContext._jvm, {}
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/generation=*/segment=*/_SUCCESS")
        for s in pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []:
            folder = s.getPath().getParent()
            out.setdefault(int(folder.getParent().getName().split("=")[1]), []).append(folder.toString())
        return out

    def _latest(self) -> tuple[int, list[str]]:
        found = self._complete()
        return (g := max(found, default=0)), found.get(g, [])

    def append(self, postings: DataFrame) -> None:
        g, segments = self._latest()
        blocks(postings).write.mode("overwrite").parquet(f"{self.path}/generation={g}/segment={len(segments)}")

    def merge(self) -> None:
        g, segments = self._latest()
        whole = postings_of(self.blocks()).groupBy("token", "doc_id").agg(F.sum("tf").alias("tf"))
        blocks(whole).write.mode("overwrite").parquet(f"{self.path}/generation={g + 1}/segment=0")
        for s in segments:
            remove(self.spark, s)

    def blocks(self) -> DataFrame:
        segments = self._latest()[1]
        return self.spark.read.schema(BLOCKS).parquet(*segments) if segments else self.spark.createDataFrame([], BLOCKS)

    def lookup(self, tokens: DataFrame | None = None) -> DataFrame:
        """(token, doc_id, tf) of all tokens, or of those in ``tokens``: other tokens' blocks are not decoded."""
        held = self.blocks()
        return postings_of(held if tokens is None else held.join(tokens.select("token").distinct(), "token", "left_semi").select(*held.columns))


# Search.


class Lists:
    """One shard's postings twice: by dimension in order of impact, in blocks whose first impact is the largest, and by
    document. ``read`` counts the postings that were looked at."""

    def __init__(self, pos: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        self.ids, doc = np.unique(doc, return_inverse=True)
        self.dims, dim = np.unique(pos, return_inverse=True)
        order = np.lexsort((doc, -impact, dim))
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(dim[order], np.arange(len(self.dims) + 1))
        order = np.lexsort((dim, doc))
        self.dim, self.own = dim[order], impact[order]
        self.row = np.searchsorted(doc[order], np.arange(len(self.ids) + 1))
        self.read = 0

    def scores(self, docs: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Whole scores of documents, from their own postings; ``query`` has a weight a dimension."""
        n = self.row[docs + 1] - self.row[docs]
        at = np.repeat(self.row[docs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        w = query[self.dim[at]]
        self.read += int(np.count_nonzero(w))
        return np.add.reduceat(w * self.own[at], np.cumsum(n) - n) if len(docs) else np.zeros(0)

    def best(self, dims: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n best documents and their scores, six digits, ties to smaller ids.

        Blocks are read where the next one promises most. A document is scored whole when it is first met, so one that was
        not met has at most the sum of what the next blocks of all dimensions promise; reading ends once that can't reach
        the n-th best score.
        """
        at = np.searchsorted(self.dims, dims)
        there = (at < len(self.dims)) & (self.dims[np.minimum(at, len(self.dims) - 1)] == dims)
        at, w = at[there], weights[there]
        query = np.zeros(len(self.dims))
        query[at] = w
        place, end = self.start[at].copy(), self.start[at + 1]
        seen = np.zeros(len(self.ids), bool)
        docs, score, floor = np.zeros(0, np.int64), np.zeros(0), -np.inf
        while True:
            open_ = place < end
            promise = np.where(open_, w * self.impact[np.minimum(place, len(self.impact) - 1)], 0.0)
            if not open_.any() or promise.sum() < floor - SLACK:
                break
            for k in np.nonzero(open_ & (promise >= promise.max() / 2))[0]:
                stop = min(place[k] + STEP, end[k])
                some = self.doc[place[k] : stop]
                self.read += len(some)
                place[k] = stop
                new = some[~seen[some]]
                seen[new] = True
                docs, score = np.append(docs, new), np.append(score, self.scores(new, query))
            if len(docs) >= n:
                floor = np.partition(score, len(score) - n)[len(score) - n]
        score = np.round(score, 6)
        order = np.lexsort((self.ids[docs], -score))[:n]
        return self.ids[docs[order]], score[order]


def _search(n: int):
    schema = pa.schema([("query_id", pa.int64()), ("cand_id", pa.int64()), ("cos_sim", pa.float64()), ("read", pa.int64()), ("postings", pa.int64())])

    def run(asked: pa.Table, docs: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        if asked.num_rows and docs.num_rows:
            lists = Lists(docs.column("pos").to_numpy(), docs.column("doc_id").to_numpy(), docs.column("impact").to_numpy())
            query, pos, w = (asked.column(c).to_numpy() for c in ("query_id", "pos", "w"))
            order = np.argsort(query, kind="stable")
            for rows in np.split(order, np.nonzero(np.diff(query[order]))[0] + 1):
                lists.read = 0
                found, score = lists.best(pos[rows], w[rows], n)
                there = int(np.diff(lists.start)[np.isin(lists.dims, pos[rows])].sum())
                # the last row says what the query cost here
                q = pa.array(np.full(len(found) + 1, query[rows[0]]))
                none = [None] * len(found)
                out.append(pa.RecordBatch.from_arrays([q, pa.array([*found.tolist(), None], pa.int64()), pa.array([*score.tolist(), None], pa.float64()), pa.array([*none, lists.read], pa.int64()), pa.array([*none, there], pa.int64())], schema=schema))
        return pa.Table.from_batches(out, schema)

    return run


def search(queries: DataFrame, docs: DataFrame, n: int, shards: int | None = None) -> DataFrame:
    """(query_id, cand_id, cos_sim, read, postings) of sparse vectors (query_id, pos, w) and (doc_id, pos, w), w > 0: in
    each shard of the documents the n best of every query that meets one, and a row without cand_id that counts the
    postings read there and those that its dimensions have.

    Documents are dealt out by hash into shards of about SHARD postings of dimensions that are asked for; each query goes
    to every shard, so what is copied are the queries, and a dimension of all documents is spread over all shards.
    """
    norm = lambda rows, key: rows.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm")).filter("_norm > 0")
    asked = queries.join(norm(queries, "query_id"), "query_id").select("query_id", "pos", (F.col("w") / F.col("_norm")).alias("w"))
    own = docs.join(norm(docs, "doc_id"), "doc_id").join(asked.select("pos").distinct(), "pos", "left_semi").select("doc_id", "pos", (F.col("w") / F.col("_norm")).alias("impact"))
    shards = shards or max(1, -(-docs.count() // SHARD))
    placed = own.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
    return sent.groupBy("shard").cogroup(placed.groupBy("shard")).applyInArrow(_search(n), "query_id long, cand_id long, cos_sim double, read long, postings long")


def more_like_this(queries: DataFrame, docs: DataFrame, n: int = 10) -> DataFrame:
    """Exact search: (query_id, rank, cand_id, cos_sim) of the n documents of largest cosine for each query."""
    found = search(queries, docs, n).filter("cand_id IS NOT NULL")
    return top_n(found, n, "cos_sim").select("query_id", "rank", "cand_id", "cos_sim")
