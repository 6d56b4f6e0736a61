"""Canonical correlation of sparse documents with their labels, and linear machines for all labels at once.

Matrices are rows: documents x terms and documents x labels as (doc_id, pos, w), blocks of vectors as (pos, c0, c1, ...).
Products are a join and a grouped sum, which is combined before its shuffle. The driver sees no document and no matrix of
the vocabulary's square. Solvers hold columns of at most ``CELLS`` numbers on the driver and send them to packed blocks of
documents; of a larger vocabulary it sees numbers of the block's width alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearlabel.operators.graph import Scratch

#: Shares in which k x k sums meet before they reach the driver; labels that are trained at once.
SHARES, LABELS = 32, 4096
#: Columns beyond the asked components that a block carries, so that the last ones that count settle soon.
EXTRA = 8
#: Numbers of the columns that a solver holds and sends at once; documents of a packed block; bytes of sums that tasks may
#: send to the driver by themselves.
CELLS, PACKED, SMALL = 1 << 23, 1024, 1 << 24


def _c(k: int, name: str = "c") -> list[str]:
    return [f"{name}{i}" for i in range(k)]


def _dots(a: str, b: str, k: int, name: str) -> dict[str, Column]:
    return {f"{name}{i}": F.sum(F.col(f"{a}{i}") * F.col(f"{b}{i}")) for i in range(k)}


def _read(found: dict, name: str, k: int) -> np.ndarray:
    return np.array([found[f"{name}{i}"] or 0.0 for i in range(k)])


def times(x: DataFrame, block: DataFrame, on: str, by: str, k: int, name: str = "c") -> DataFrame:
    """(by, c0, ...): the sums of w times the rows of ``block`` that ``on`` names."""
    met = x.join(block.select(on, *[F.col(f"{name}{i}").alias(f"c{i}") for i in range(k)]), on)
    return met.groupBy(by).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in _c(k)])


class Centred:
    """A sparse matrix (doc_id, pos, w) as if each column's mean were taken off; ``n`` documents, empty ones included."""

    def __init__(self, rows: DataFrame, n: int, scratch: Scratch, ridge: float):
        self.rows, self.n, self.scratch, self.ridge = rows, n, scratch, ridge
        self.means, found = scratch.counted(rows.groupBy("pos").agg((F.sum("w") / n).alias("mean"), F.lit(True).alias("there")), "means", first=F.min("pos"), last=F.max("pos"))
        #: positions 0, 1, ... that columns need
        self.size = (found["last"] or 0) + 1 if (found["first"] or 0) >= 0 else CELLS + 1

    def mean_of(self, block: DataFrame, k: int) -> np.ndarray:
        """The columns' means times the block: what its product with the matrix is off by in every document."""
        return _read(block.join(self.means, "pos").agg(*[F.sum(F.col("mean") * F.col(c)).alias(f"m{i}") for i, c in enumerate(_c(k))]).first().asDict(), "m", k)

    def onto(self, block: DataFrame, k: int, name: str = "c") -> DataFrame:
        """(doc_id, c...): the product of the plain matrix with a block; documents without entries have no row, as it is
        zero. Minus ``mean_of`` it is that of the centred one."""
        return times(self.rows, block, "pos", "doc_id", k, name)

    def back(self, docs: DataFrame, mean: np.ndarray, k: int) -> DataFrame:
        """(pos, mean, c...): the transposed centred matrix times a block of documents from which ``mean`` is taken off;
        documents that the block lacks are zero before that."""
        met = self.means.join(times(self.rows, docs, "doc_id", "pos", k), "pos", "left")
        return met.select("pos", "mean", *[(F.coalesce(c, F.lit(0.0)) - F.col("mean") * (self.n * float(m))).alias(c) for c, m in zip(_c(k), mean, strict=True)])

    def solve(self, right: DataFrame, k: int, tol: float, most: int) -> DataFrame:
        """(pos, c...) with (X'X + ridge) c = right, a result of ``back``, X centred: conjugate gradients of all columns side by side."""
        return (self._solve_sent if self.size <= CELLS else self._solve_joined)(right, k, tol, most)

    def _solve_sent(self, right: DataFrame, k: int, tol: float, most: int) -> DataFrame:
        """A round sends the columns to packed blocks of documents, as many at a time as ``CELLS`` holds."""
        given = right.select("pos", "mean", *_c(k)).toArrow()
        pos = given.column("pos").to_numpy()
        b, mean = np.zeros((self.size, k)), np.zeros(self.size)
        mean[pos] = given.column("mean").to_numpy()
        for i, c in enumerate(_c(k)):
            b[pos, i] = given.column(c).to_numpy()
        blocks = self.scratch.cut(packed(self.rows), "blocks")
        width = max(1, CELLS // self.size)
        a = np.concatenate([self._gradients(blocks, mean, b[:, lo : lo + width], tol, most) for lo in range(0, k, width)], axis=1)
        solved = self.rows.sparkSession.createDataFrame(pa.table({"pos": pos, **{c: a[pos, i] for i, c in enumerate(_c(k))}}))
        return self.scratch.cut(solved, "solved")

    def _gradients(self, blocks: DataFrame, mean: np.ndarray, b: np.ndarray, tol: float, most: int) -> np.ndarray:
        a, r, p = np.zeros_like(b), b.copy(), b.copy()
        rr = (r * r).sum(axis=0)
        goal = max(tol * tol, 1e-14) * np.maximum(rr, 1e-300)
        for _ in range(most):
            go = rr > goal
            if not go.any():
                break
            w = squared(blocks, p) - np.outer(mean, self.n * (mean @ p)) + self.ridge * p
            pw = (p * w).sum(axis=0)
            go &= pw > 0
            alpha = np.where(go, rr / np.where(go, pw, 1), 0)
            a, r = a + alpha * p, r - alpha * w
            after = np.where(go, (r * r).sum(axis=0), rr)
            p, rr = r + np.where(go, after / np.where(go, rr, 1), 0) * p, after
        return a

    def _solve_joined(self, right: DataFrame, k: int, tol: float, most: int) -> DataFrame:
        """A round is one job: its sums are observed while its state is written, and give the next one's steps."""
        state = right.select("pos", "mean", *_c(k))
        sums = _dots("c", "c", k, "rr") | {f"m{i}": F.sum(F.col("mean") * F.col(f"c{i}")) for i in range(k)}
        start = state.select("pos", "mean", *[F.col(f"c{i}").alias(f"r{i}") for i in range(k)], *[F.col(f"c{i}").alias(f"p{i}") for i in range(k)], *[F.lit(0.0).alias(f"a{i}") for i in range(k)], *_c(k))
        state, found = self.scratch.counted(start, "solve", **sums)
        state = state.drop(*_c(k))
        rr, mean = _read(found, "rr", k), _read(found, "m", k)
        # the sums of squares are carried on, so they can't be told from zero below about 1e-14 of the first
        goal, mean_r, held = max(tol * tol, 1e-14) * np.maximum(rr, 1e-300), mean.copy(), None
        for _ in range(most):
            if (rr <= goal).all():
                break
            w = self.back(self.onto(state, k, "p"), mean, k).drop("mean")
            joined = state.join(w, "pos").select("pos", "mean", *[c for n in "rpa" for c in _c(k, n)], *[(F.col(f"c{i}") + self.ridge * F.col(f"p{i}")).alias(f"w{i}") for i in range(k)])
            sums = _dots("p", "w", k, "pw") | _dots("r", "w", k, "rw") | _dots("w", "w", k, "ww") | {f"mw{i}": F.sum(F.col("mean") * F.col(f"w{i}")) for i in range(k)}
            whole, found = self.scratch.counted(joined, "solve", **sums)
            if held is not None:
                self.scratch.drop(held)
            held = whole
            pw, rw, ww, mw = (_read(found, n, k) for n in ("pw", "rw", "ww", "mw"))
            go = (rr > goal) & (pw > 0)
            alpha = np.where(go, rr / np.where(go, pw, 1), 0)
            after = np.maximum(rr - 2 * alpha * rw + alpha * alpha * ww, 0)
            beta = np.where(go, after / np.where(rr > 0, rr, 1), 0)
            mean_r = mean_r - alpha * mw
            rr, mean = np.where(go, after, rr), mean_r + beta * mean
            new = {"r": lambda i: F.col(f"r{i}") - float(alpha[i]) * F.col(f"w{i}"), "p": lambda i: F.col(f"r{i}") - float(alpha[i]) * F.col(f"w{i}") + float(beta[i]) * F.col(f"p{i}"), "a": lambda i: F.col(f"a{i}") + float(alpha[i]) * F.col(f"p{i}")}  # noqa: B023
            state = whole.select("pos", "mean", *[f(i).alias(f"{n}{i}") for n, f in new.items() for i in range(k)])
        return self.scratch.cut(state.select("pos", *[F.col(f"a{i}").alias(f"c{i}") for i in range(k)]), "solved")


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of documents of (doc_id, pos, w): their different positions, and of the entries, document by document, their
    number, place among these positions and weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PACKED):
                lists = batch.column(0).slice(lo, PACKED)
                flat = lists.flatten()
                terms, at = np.unique(flat.field("pos").to_numpy(), return_inverse=True)
                made = (terms, lists.value_lengths().to_numpy().astype(np.int64), at.astype(np.int32), flat.field("w").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()) for m in made], names=["terms", "sizes", "at", "w"])

    entries = rows.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("w").cast("double").alias("w"))).alias("v"))
    return entries.select("v").mapInArrow(run, "terms binary, sizes binary, at binary, w binary")


def squared(blocks: DataFrame, p: np.ndarray) -> np.ndarray:
    """X'X p of the plain matrix in blocks: each task adds up its blocks, and sends on the positions that it met, in slices
    that are added up over tasks."""
    size, k = p.shape
    sent = blocks.sparkSession.sparkContext.broadcast(p)
    step = -(-size // SHARES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, total, met = sent.value, np.zeros((size, k)), np.zeros(size, bool)
        for batch in batches:
            for raw in zip(*(batch.column(i) for i in range(4)), strict=True):
                terms, sizes, at, w = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(raw, (np.int64, np.int64, np.int32, np.float64), strict=True))
                own = p[terms]
                own_sums = np.empty_like(own)
                for j in range(k):
                    u = np.add.reduceat(own[:, j][at] * w, np.cumsum(sizes) - sizes)
                    own_sums[:, j] = np.bincount(at, np.repeat(u, sizes) * w, len(terms))
                total[terms] += own_sums
                met[terms] = True
        pos = np.flatnonzero(met)
        cuts = np.searchsorted(pos, np.arange(0, SHARES + 1) * step)
        for share, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if lo < hi:
                yield pa.RecordBatch.from_arrays([pa.array([share], pa.int32()), pa.array([pos[lo:hi].tobytes()], pa.binary()), pa.array([total[pos[lo:hi]].tobytes()], pa.binary())], names=["share", "pos", "m"])

    def added(t: pa.Table) -> pa.Table:
        share = t.column("share")[0].as_py()
        total = np.zeros((step, k))
        for pos, m in zip(t.column("pos").to_pylist(), t.column("m").to_pylist(), strict=True):
            total[np.frombuffer(pos, np.int64) - share * step] += np.frombuffer(m).reshape(-1, k)
        return pa.table({"share": pa.array([share], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})

    found = blocks.mapInArrow(run, "share int, pos binary, m binary").groupBy("share").applyInArrow(added, "share int, m binary").collect()
    out = np.zeros((SHARES * step, k))
    for r in found:
        out[r.share * step : (r.share + 1) * step] = np.frombuffer(r.m).reshape(-1, k)
    sent.unpersist()
    return out[:size]


def gram(rows: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """left' right over all rows: each task's product, summed in SHARES shares and then on the driver."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(left), len(right)))
        for b in batches:
            total += np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in left]) @ np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in right]).T
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def added(t: pa.Table) -> pa.Table:
        return pa.table({"m": pa.array([sum(np.frombuffer(m) for m in t.column("m").to_pylist()).tobytes()], pa.binary())})

    parts = rows.select(*dict.fromkeys(left + right)).mapInArrow(product, "m binary").withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
    found = parts.groupBy("share").applyInArrow(added, "m binary").collect()
    return sum((np.frombuffer(r.m) for r in found), np.zeros(len(left) * len(right))).reshape(len(left), len(right))


def rotated(block: DataFrame, key: str, turn: np.ndarray) -> DataFrame:
    """The block's columns times a k x k matrix."""
    k = len(turn)
    return block.select(key, *[reduce(lambda s, i, j=j: s + F.col(f"c{i}") * float(turn[i, j]), range(1, k), F.col("c0") * float(turn[0, j])).alias(f"c{j}") for j in range(turn.shape[1])])


def canonical(x: DataFrame, y: DataFrame, n: int, labels: int, scratch: Scratch, components: int = 100, ridge: float = 1.0, tol: float = 1e-4, most: int = 200, rounds: int = 10) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Canonical vectors of documents x terms and documents x labels, both (doc_id, pos, w), centred, with ``ridge`` on
    both sides' squares: (pos, c...) of terms, (pos, c...) of labels, and the correlations, largest first.

    Block power iteration on the labels' side: each round solves for the terms and then for the labels. A block as wide
    as there are labels holds every direction, so one round is enough; a narrower one takes ``rounds``. The k x k problem
    that is left is solved on the driver. ``labels``: their number, positions 0, 1, ...
    """
    k = min(components + EXTRA, labels)
    left, right = Centred(x, n, scratch, ridge), Centred(y, n, scratch, ridge)
    whole = k == labels
    first = lambda i: (F.col("pos") == i).cast("double") if whole else F.pmod(F.xxhash64("pos", F.lit(i)), F.lit(1 << 20)) / (1 << 19) - 1.0
    b = scratch.cut(right.means.select("pos", *[first(i).alias(f"c{i}") for i in range(k)]), "labels")
    for _ in range(1 if whole else rounds):
        a = left.solve(left.back(right.onto(b, k), right.mean_of(b, k), k), k, tol, most)
        if whole:
            break
        b = right.solve(right.back(left.onto(a, k), left.mean_of(a, k), k), k, tol, most)
        size = np.sqrt(np.diag(gram(b, _c(k), _c(k))))
        if k > 1:  # orthogonal columns, so that they don't all turn to the first direction
            low = np.linalg.cholesky(gram(b, _c(k), _c(k)) / np.outer(size, size) + 1e-12 * np.eye(k))
            b = scratch.cut(rotated(b, "pos", np.diag(1 / size) @ np.linalg.inv(low).T), "labels")
    u, mu, v, mv = left.onto(a, k), left.mean_of(a, k), right.onto(b, k), right.mean_of(b, k)
    both = u.withColumnsRenamed({f"c{i}": f"u{i}" for i in range(k)}).join(v.withColumnsRenamed({f"c{i}": f"v{i}" for i in range(k)}), "doc_id", "full")
    off = lambda name, mean: [(F.coalesce(f"{name}{i}", F.lit(0.0)) - float(mean[i])).alias(f"{name}{i}") for i in range(k)]
    filled = both.select("doc_id", *off("u", mu), *off("v", mv))
    filled = scratch.cut(filled, "both")
    g, rest = gram(filled, _c(k, "u") + _c(k, "v"), _c(k, "u") + _c(k, "v")), n - filled.count()
    empty = np.concatenate([-mu, -mv])
    g += rest * np.outer(empty, empty)  # documents with neither terms nor labels
    gx, gy, gxy = g[:k, :k] + ridge * gram(a, _c(k), _c(k)), g[k:, k:] + ridge * gram(b, _c(k), _c(k)), g[:k, k:]
    wx, wy = _whitened(gx), _whitened(gy)
    p, rho, q = np.linalg.svd(wx.T @ gxy @ wy)
    m = min(components, len(rho))
    return scratch.cut(rotated(a, "pos", wx @ p[:, :m]), "terms"), scratch.cut(rotated(b, "pos", wy @ q.T[:, :m]), "labels"), rho[:m]


def _whitened(g: np.ndarray) -> np.ndarray:
    """Columns w with w' g w = 1; directions without length go."""
    value, vector = np.linalg.eigh((g + g.T) / 2)
    use = value > 1e-10 * max(value.max(initial=0), 1e-300)
    return vector[:, use] / np.sqrt(value[use])


def _gradient(weights, labels: int, width: int):
    """A task's sums over documents (z: features and a one; own: labels that it has) of the squared hinge's gradient."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total = weights.value, np.zeros((labels, width))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                z = np.asarray(part.column("z").flatten()).reshape(-1, width)
                sign = -np.ones((len(z), labels))
                own = part.column("own")
                sign[np.repeat(np.arange(len(z)), own.value_lengths().to_numpy()), np.asarray(own.flatten())] = 1
                slack = np.maximum(0, 1 - sign * (z @ w.T))
                total -= 2 * (slack * sign).T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    return run


def machines(rows: DataFrame, width: int, labels: int, penalty: float = 1.0, rounds: int = 60) -> Iterator[tuple[int, np.ndarray]]:
    """Linear machines (squared hinge, penalty / 2 |w|^2, the last feature is the constant and not penalized) of all
    labels: (first label, weights of a block of at most LABELS). ``rows``: (z array of width, own array of label numbers).

    One accelerated gradient step a round for all labels of a block, each task summing over its documents; the step is
    from the largest possible curvature, 2 |Z|^2 + penalty. Labels stay numbers; the driver holds one block.
    """
    spark = rows.sparkSession
    z = rows.select(*[F.get("z", F.lit(i)).alias(f"c{i}") for i in range(width)])
    curve = 2 * float(np.linalg.eigvalsh(gram(z, _c(width), _c(width))).max(initial=0)) + penalty
    ridge = np.full(width, penalty)
    ridge[-1] = 1e-9 * curve
    for first in range(0, labels, LABELS):
        here = min(LABELS, labels - first)
        own = rows.select("z", F.transform(F.filter("own", lambda x: (x >= first) & (x < first + here)), lambda x: (x - first).cast("int")).alias("own"))
        few = own.rdd.getNumPartitions() * here * width * 8 <= SMALL
        w, ahead, t = np.zeros((here, width)), np.zeros((here, width)), 1.0
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(ahead)
            parts = own.mapInArrow(_gradient(sent, here, width), "m binary")
            if not few:
                parts = parts.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES))).groupBy("share").applyInArrow(lambda x: pa.table({"m": pa.array([sum(np.frombuffer(m) for m in x.column("m").to_pylist()).tobytes()], pa.binary())}), "m binary")
            found = parts.collect()
            step = sum((np.frombuffer(r.m) for r in found), np.zeros(here * width)).reshape(here, width) + ahead * ridge
            before, w = w, ahead - step / curve
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, t = w + (t - 1) / after * (w - before), after
            sent.unpersist()
        yield first, w
