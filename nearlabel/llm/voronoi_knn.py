"""Exact top-k inner products by a Voronoi kNN join.

Vectors become integers, floor(scale * x). Largest inner products are nearest neighbours after one more coordinate:
a candidate c gets sqrt(M - |c|^2), M the largest squared norm, a query q gets 0, and |q' - c'|^2 = |q|^2 + M - 2 q.c.
Pivots (a bounded sample of candidates) divide the space into cells. A cell's summary is its number of candidates, the
range of their distances to the pivot, and the few smallest of these. From the summaries alone each query gets a bound
that at least k candidates keep, and only cells that can reach below it are sought: the query, the smaller side, is
replicated to their blocks. A block holds a bounded number of a cell's candidates, so a crowded cell is many tasks; more
queries than a task takes are dealt into slices by their own cell, and a block is copied to those slices alone that seek
it, and not moved at all if none does. A task answers all its queries with one matrix product, in exact integers, and
what tasks return meets once more by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most pivots (their pairwise work and what is broadcast grow with it); most candidates and queries that meet in a task.
PIVOTS, BLOCK, QUERIES = 256, 8192, 65536
#: Smallest distances in a summary beyond the k that are asked for.
SPARE = 8
#: Components of this size and more take no part, nor do integer vectors whose squares sum to EXACT: no score is larger than
#: that sum, and sums of integers below it are exact.
LARGEST, EXACT = float(1 << 18), 1 << 53
#: Relative slack of the bounds, which are floats; scores are integers.
SLACK = 1e-6


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _lifted(v: np.ndarray, top: float) -> np.ndarray:
    """Candidates with their additional coordinate."""
    v = v.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0))


def _good(x: Column) -> Column:
    """Not empty, without null or non-finite components, none of LARGEST or more in size."""
    return F.coalesce((F.size(x) > 0) & F.forall(x, lambda c: F.coalesce((c < LARGEST) & (c > -LARGEST), F.lit(False))), F.lit(False))


def length_of(df: DataFrame, key: str, embedding: str) -> int:
    """The length of the vector that decides: that of the smallest id, of several the shortest; 0 if there is none."""
    x = F.col(embedding)
    head = df.filter(_good(x)).agg(F.min(F.struct(F.col(key).isNull(), F.col(key), F.size(x).alias("n"))).alias("least")).first().least
    return head.n if head else 0


def vectors(df: DataFrame, key: str, embedding: str, scale: int, length: int) -> DataFrame:
    """id, v (integers), norm2 of the rows that take part."""
    x = F.col(embedding)
    good = _good(x) & (F.size(x) == length)
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("bigint"))
    return df.filter(F.coalesce(good, F.lit(False))).select(F.col(key).cast("bigint").alias("id"), v.alias("v")).withColumn("norm2", F.aggregate("v", F.lit(0).cast("bigint"), lambda a, c: a + c * c)).filter(F.col("norm2") < EXACT)


def _assign(pivots: np.ndarray, top: float):
    """Each candidate's cell (the nearest pivot, the first among equals) and its distance to the pivot."""
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.int64())), ("cell", pa.int32()), ("far", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_lifted(_matrix(batch.column(1)), top), pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.int64())), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], schema=schema)

    return run


class Cells:
    """Summaries of the cells: pivots, number of candidates, least and largest distance to the pivot, the smallest
    distances (padded with infinity), and blocks."""

    def __init__(self, pivots: np.ndarray, rows: list[tuple[int, int, float, float, list[float]]], size: int):
        self.number = {cell: i for i, (cell, *_) in enumerate(rows)}
        self.pivots = pivots[[r[0] for r in rows]]
        self.n = np.array([r[1] for r in rows], np.int64)
        self.near, self.far = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        self.first = np.full((len(rows), max(len(r[4]) for r in rows)), np.inf)
        for i, r in enumerate(rows):
            self.first[i, : len(r[4])] = sorted(r[4])
        self.blocks = np.maximum(1, -(-self.n // size))

    def sought(self, q: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cells: which queries (with the number of candidates that each needs within its bound) may have one of
        their best in which cells; and each query's own cell, the nearest."""
        d = _distances(np.hstack([q, np.zeros((len(q), 1))]), self.pivots)
        slack = SLACK * (1 + d.max(axis=1, keepdims=True) + self.far.max())
        # no candidate is farther than by way of its pivot: each of the first ones, and all others by the farthest
        known = np.isfinite(self.first).sum(axis=1)
        at = np.concatenate([(d[:, :, None] + self.first[None]).reshape(len(q), -1), d + self.far], axis=1)
        times = np.concatenate([np.isfinite(self.first).astype(np.int64).ravel(), self.n - known])
        order = np.argsort(at, axis=1)
        enough = np.cumsum(times[order], axis=1) >= wanted[:, None]
        last = np.where(enough.any(axis=1), enough.argmax(axis=1), 0)
        bound = np.where(enough.any(axis=1), at[np.arange(len(q)), order[np.arange(len(q)), last]], np.inf)[:, None]
        least = np.maximum(np.maximum(d - self.far, self.near - d), 0)
        return np.nonzero(least <= bound + slack), d.argmin(axis=1)


def _reach(cells: Cells, k: int):
    """For each query (id, v, copies: rows with its id) the blocks of all cells that may hold one of its k best candidates,
    itself not counted; own: the query's own cell."""
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.int64())), ("own", pa.int32()), ("cell", pa.int32()), ("block", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                (row, cell), own = cells.sought(_matrix(batch.column(1)).astype(np.float64), k + np.array(batch.column(2)))
                times = cells.blocks[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                for a in range(0, len(row), 4096):
                    use = row[a : a + 4096]
                    part = batch.take(pa.array(use))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.list_(pa.int64())), pa.array(own[use], pa.int32()), pa.array(cell[a : a + 4096], pa.int32()), pa.array(block[a : a + 4096], pa.int32())], schema=schema)

    return run


def _own(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(0)).astype(np.float64)
            d = _distances(np.hstack([q, np.zeros((len(q), 1))]), cells.pivots)
            yield pa.RecordBatch.from_arrays([pa.array(d.argmin(axis=1), pa.int32())], names=["own"])

    return run


def _slices(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each own cell the first slice and the number of slices of its queries, at most about QUERIES in one."""
    out, at, held = {}, 0, 0
    for cell, n in sorted(counts.items()):
        if held and held + n > QUERIES:
            at, held = at + 1, 0
        more = -(-n // QUERIES) if n > QUERIES else 1
        out[cell] = at, more
        at, held = (at + more, 0) if more > 1 else (at, held + n)
    return out


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k largest scores without its own id, ties to smaller ids: row numbers and columns."""
    scores = np.where(ids == own[:, None], -np.inf, scores)
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k] if len(ids) <= 4 * (k + 1) else None
    if order is None:
        kth = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
        rows, cols = np.nonzero(scores >= kth[:, None])
    else:
        rows, cols = np.repeat(np.arange(len(scores)), order.shape[1]), order.ravel()
    keep = ids[cols] != own[rows]
    rows, cols = rows[keep], cols[keep]
    o = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[o], cols[o]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], cols[rank < k]


def _solve(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if queries.num_rows and candidates.num_rows:
            ids, c = np.array(candidates.column("id")), _matrix(candidates.column("v")).astype(np.float64)
            for lo in range(0, queries.num_rows, 256):
                part = queries.slice(lo, 256)
                own = np.array(part.column("id"))
                scores = _matrix(part.column("v")).astype(np.float64) @ c.T  # integers below 2**53 are exact
                rows, cols = _best(scores, ids, own, k)
                for o, x in zip(out, (own[rows], ids[cols], scores[rows, cols].astype(np.int64)), strict=True):
                    o.append(x)
        return pa.table({n: pa.array(np.concatenate(o) if o else [], pa.int64()) for n, o in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return run


def knn_join(df: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", embedding: str = "embedding", scale: int = 256, work: str | None = None) -> DataFrame:
    """For each row of ``queries`` (rows of ``df``) its k largest integer inner products with all other rows of ``df``.

    query_id, rank (from 1), vec_id, score; ties to the smaller vec_id; fewer rows where there are fewer candidates.
    A row is no candidate of a query with its own id; repeated rows of one id count once each as candidates and answer
    as one query, with the least vector where they differ. Rows whose vector is null, empty, holds a null or non-finite
    component, one of LARGEST and more in size or squares that sum to EXACT, or has another length than that of the smallest id (of several, the
    shortest) take no part, neither as candidates nor as queries. ``work``: a shared folder for the assigned
    candidates, which are read three times; without it they are computed again. Extra columns are dropped.
    """
    plan = _plan(df, queries, k, key, embedding, scale, work)
    if plan is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sought, placed = plan
    by = ("cell", "block", "slice")
    local = sought.groupBy(*by).cogroup(placed.groupBy(*by)).applyInArrow(_solve(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _plan(df: DataFrame, queries: DataFrame, k: int, key: str, embedding: str, scale: int, work: str | None) -> tuple[DataFrame, DataFrame] | None:
    """Queries (id, v, own, cell, block, slice) and the candidates (id, v, cell, block, slice) that they seek."""
    spark = df.sparkSession
    length = length_of(df, key, embedding)
    data = vectors(df, key, embedding, scale, length)
    asked = vectors(queries, key, embedding, scale, length).groupBy("id").agg(F.min("v").alias("v"))
    head = data.agg(F.max("norm2").alias("top"), F.count(F.lit(1)).alias("n")).first()
    if not head.n:
        return None
    count = min(PIVOTS, max(1, int(head.n**0.5) // 2))
    chosen = data.select("v").orderBy(F.xxhash64("id", "v")).limit(count).toPandas()["v"]
    pivots = _lifted(np.array(chosen.tolist(), np.int64), float(head.top))
    cells = data.select("id", "v").mapInArrow(_assign(pivots, float(head.top)), "id long, v array<long>, cell int, far double")
    if work:
        cells.write.mode("overwrite").parquet(work)
        cells = spark.read.parquet(work)
    ranked = cells.select("cell", "far").withColumn("at", F.row_number().over(Window.partitionBy("cell").orderBy("far"))).filter(F.col("at") <= k + SPARE)
    firsts = ranked.groupBy("cell").agg(F.collect_list("far").alias("first"))
    summary = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).join(firsts, "cell").orderBy("cell").collect()
    known = Cells(pivots, [(r.cell, r.n, r.near, r.far, r["first"]) for r in summary], BLOCK)
    renamed = spark.createDataFrame([(c, i, int(known.blocks[i])) for c, i in known.number.items()], "cell int, number int, blocks int")
    placed = cells.join(F.broadcast(renamed), "cell").select("id", "v", F.col("number").alias("cell"), F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int").alias("block"))
    repeated = cells.groupBy("id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    sized = asked.join(repeated, "id", "left").select("id", "v", F.coalesce("copies", F.lit(1)).alias("copies"))
    counts = {r.own: r["count"] for r in asked.select("v").mapInArrow(_own(known), "own int").groupBy("own").count().collect()}
    dealt = spark.createDataFrame([(c, a, m) for c, (a, m) in _slices(counts).items()], "own int, at int, more int")
    sought = sized.mapInArrow(_reach(known, k), "id long, v array<long>, own int, cell int, block int").join(F.broadcast(dealt), "own")
    sought = sought.withColumn("slice", F.col("at") + F.pmod(F.xxhash64("id"), F.col("more")).cast("int")).drop("at", "more")
    needed = sought.select(F.col("cell").alias("c"), F.col("block").alias("b"), F.col("slice").alias("s")).distinct()
    met = placed.join(needed, (F.col("cell") == F.col("c")) & (F.col("block") == F.col("b")))
    return sought, met.select("id", "v", F.col("c").alias("cell"), F.col("b").alias("block"), F.col("s").alias("slice"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
