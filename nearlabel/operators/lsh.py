"""Sign-random-projection hashing into bounded first-in-first-out buckets, and candidates by collisions.

A plane's weight is a pure function of (table, bit, dimension, seed): +1 or -1 from md5, so a vocabulary that grows needs
no copies and any engine reproduces the bits. Weights are integers (micro units), so signs are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from nearlabel.operators.dictionary import with_rank
from nearlabel.operators.graph import Scratch

try:  # half the cost of a call
    from _md5 import md5
except ImportError:
    from hashlib import md5

#: Arrivals of a bucket that meet in one task.
CROWDED = 1 << 16
#: Held entries and queries that meet in one task, and pairs that it counts at once.
HELD, ASKING, PAIRS = 1 << 23, 1 << 16, 1 << 21
#: The same where all pairs are passed on.
COUNTING = 1 << 15
#: Null ids travel as the least long.
LEAST = -(1 << 63)
#: Positions whose signs a task keeps; weights and vectors that it multiplies at once.
KNOWN, ROWS, VECTORS = 1 << 20, 512, 2048


@dataclass(frozen=True)
class Params:
    """Tables, bits a table, capacity of a bucket, rows a batch, candidates that reach the cosine, results, least similarity."""

    tables: int = 36
    bits: int = 13
    capacity: int = 200
    batch: int = 100
    top_candidates: int = 108
    top_k: int = 36
    min_sim: float = 0.0
    seed: int = 7


def plane_bits(tbl: Column, dim: Column, seed: int) -> Column:
    """32 hex digits; a digit below 8 is +1 for its bit, else -1."""
    return F.md5(F.concat_ws(":", tbl.cast("string"), dim.cast("string"), F.lit(str(seed))).cast("binary"))


def masks(positions: DataFrame, p: Params) -> DataFrame:
    """(pos, masks): for every position and table an integer whose bit b is set where plane b has +1."""
    signs = lambda h: F.translate(h, "0123456789abcdef", "1" * 8 + "0" * 8)
    mask = lambda t: F.conv(F.reverse(F.substr(signs(plane_bits(t, F.col("pos"), p.seed)), F.lit(1), F.lit(p.bits))), 2, 10).cast("int")
    return positions.select("pos").distinct().select("pos", F.transform(F.sequence(F.lit(0), F.lit(p.tables - 1)), mask).alias("masks"))


def planes(positions: DataFrame, p: Params) -> DataFrame:
    """(tbl, bit, dim, w) of all planes, in the dimensions that occur in ``positions`` (pos)."""
    bits = masks(positions, p).select(F.col("pos").cast("int").alias("dim"), F.posexplode("masks").alias("tbl", "mask"))
    bits = bits.select("tbl", "dim", "mask", F.explode(F.sequence(F.lit(0), F.lit(p.bits - 1))).alias("bit"))
    return bits.select("tbl", "bit", "dim", F.when(F.call_function("shiftright", "mask", "bit").bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1).alias("w"))


class Planes:
    """Signs of positions in all planes as bits, a byte row a position: table by table, a table's first bit first.
    Rows of positions below ``KNOWN`` are kept."""

    def __init__(self, p: Params):
        self.p, self.n = p, p.tables * p.bits
        self.rows, self.known = np.zeros((0, -(-self.n // 8)), np.uint8), np.zeros(0, bool)

    def made(self, positions: list[int]) -> np.ndarray:
        tables = [f"{t}:".encode() for t in range(self.p.tables)]
        digests = [md5(t + rest).digest() for i in positions for rest in [f"{i}:{self.p.seed}".encode()] for t in tables]
        d = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)
        digits = np.stack([d & 0x80, d & 0x08], axis=2).reshape(len(d), 32)[:, : self.p.bits]  # below 8: +1
        return np.packbits((digits == 0).reshape(len(positions), self.n), axis=1)

    def fetched(self, pos: np.ndarray, sent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The byte rows of different positions, made where they aren't among those of ``signs``."""
        held, rows = sent
        at = np.minimum(np.searchsorted(held, pos), max(0, len(held) - 1))
        there = held[at] == pos if len(held) else np.zeros(len(pos), bool)
        out = np.empty((len(pos), -(-self.n // 8)), np.uint8)
        out[there], out[~there] = rows[at[there]], self.made(pos[~there].tolist())
        return out

    def of(self, pos: np.ndarray) -> np.ndarray:
        """The byte rows of positions."""
        if len(pos) and (pos.min() < 0 or pos.max() >= KNOWN):
            different, at = np.unique(pos, return_inverse=True)
            return self.made(different.tolist())[at]
        more = int(pos.max(initial=-1)) + 1 - len(self.known)
        if more > 0:
            more = max(more, min(len(self.known), KNOWN - len(self.known)))
            self.rows = np.concatenate([self.rows, np.zeros((more, self.rows.shape[1]), np.uint8)])
            self.known = np.concatenate([self.known, np.zeros(more, bool)])
        new = np.unique(pos[~self.known[pos]])
        if len(new):
            self.rows[new], self.known[new] = self.made(new.tolist()), True
        return self.rows[pos]

    def sums(self, lists: pa.Array) -> np.ndarray:
        """The dot products of sparse vectors, lists of (pos, q) without nulls, with all planes: a row a vector."""
        pos, q = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("pos", "q"))
        return self.products(pos, q, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))

    def products(self, pos: np.ndarray, q: np.ndarray, ends: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """As ``sums``, of vectors that end before ``ends`` in their positions and weights. With ``rows``, positions are the
        numbers of these byte rows."""
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        upto = np.concatenate([[0.0], np.cumsum(np.abs(q.astype(np.float64)))])
        largest = float(np.max(upto[ends] - upto[starts], initial=0.0))
        if largest >= 2.0**62:
            raise OverflowError("weights of a vector add up to more than 64 bits hold")
        kind = np.float64 if upto[-1] < 2.0**52 else np.int64  # either way exact
        q, out = q.astype(kind), np.zeros((len(ends), self.n), kind)
        for lo in range(0, len(pos), ROWS):
            hi = min(lo + ROWS, len(pos))
            ones = np.unpackbits(self.of(pos[lo:hi]) if rows is None else rows[pos[lo:hi]], axis=1, count=self.n).astype(kind)
            for k in range(int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(starts, hi, "left"))):
                i, j = max(lo, int(starts[k])), min(hi, int(ends[k]))
                if i < j:
                    out[k] += 2 * (q[i:j] @ ones[i - lo : j - lo]) - q[i:j].sum()
        return out.astype(np.int64)

    def buckets(self, pos: np.ndarray, q: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """A row a vector that has weights, with its bucket in every table."""
        powers, out = 1 << np.arange(self.p.bits, dtype=np.int32), np.zeros((len(ends), self.p.tables), np.int32)
        for lo in range(0, len(ends), VECTORS):
            own = ends[lo : lo + VECTORS]
            first, last = (int(ends[lo - 1]) if lo else 0), int(own[-1])
            sums = self.products(pos[first:last], q[first:last], own - first, rows)
            out[lo : lo + VECTORS] = (sums.reshape(-1, self.p.tables, self.p.bits) >= 0) @ powers
        return out


def signs(known: DataFrame, p: Params):
    """Positions and their byte rows for a dictionary (position, df), made once, each in a task, and sent to all workers: of
    the words with the most documents, ``KNOWN`` at most. The others are rare, so it is cheap to make theirs where they are met."""
    counts = known.groupBy("df").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("df", "descending")])
    many = counts["df"].to_numpy()[np.cumsum(counts["n"].to_numpy()) <= KNOWN]
    often = F.col("df") >= int(many[-1]) if len(many) else F.lit(False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Planes(p)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                pos = batch.column(0).slice(lo, ROWS)
                yield pa.RecordBatch.from_arrays([pos, pa.array(list(map(bytes, planes.made(pos.to_pylist()))), pa.binary())], names=["pos", "bits"])

    few = known.filter(often).select(F.col("position").cast("long").alias("pos")).repartition(known.sparkSession.sparkContext.defaultParallelism)
    found = few.mapInArrow(run, "pos long, bits binary").toArrow().sort_by("pos")
    rows = np.frombuffer(b"".join(found["bits"].to_pylist()), np.uint8).reshape(len(found), -(-p.tables * p.bits // 8))
    return known.sparkSession.sparkContext.broadcast((found["pos"].to_numpy(), rows))


def micro(w: np.ndarray) -> np.ndarray:
    """Integer weights, as ``round(w * 1000000)`` of the engine gives them: halves go away from zero."""
    x = w * 1_000_000
    whole = np.trunc(x)
    return (whole + np.sign(x) * (np.abs(x - whole) >= 0.5)).astype(np.int64)


@lru_cache(1)
def planes_of(p: Params) -> Planes:
    """One for all tasks of a process."""
    return Planes(p)


def _each(vectors: DataFrame, p: Params, doc: str, columns: str, made: Callable) -> DataFrame:
    """Rows (doc, tbl, columns) of vectors (doc, pos, q): ``made`` gives the columns from all sums (vectors, tables, bits)
    and from whether a vector has weights at all. Only the vectors are shuffled."""
    weight = F.when(F.col("pos").isNotNull() & F.col("q").isNotNull(), F.struct(F.col("pos").cast("long").alias("pos"), F.col("q").cast("long").alias("q")))
    packed = vectors.groupBy(doc).agg(F.collect_list(weight).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = planes_of(p)
        for batch in batches:
            for lo in range(0, batch.num_rows, VECTORS):
                part = batch.slice(lo, VECTORS)
                n, lists = part.num_rows, part.column("v")
                sums = planes.sums(lists).reshape(n, p.tables, p.bits)
                weighed = np.repeat(lists.value_lengths().to_numpy(zero_copy_only=False) > 0, p.tables)
                ids = part.column(doc).take(pa.array(np.repeat(np.arange(n), p.tables)))
                tables = pa.array(np.tile(np.arange(p.tables, dtype=np.int32), n))
                yield pa.RecordBatch.from_arrays([ids, tables, *made(sums.reshape(-1, p.bits), weighed)], names=names)

    schema = f"`{doc}` {dict(vectors.dtypes)[doc]}, tbl int, {columns}"
    names = [doc, "tbl", *[c.split()[0] for c in columns.split(", ")]]
    return packed.mapInArrow(run, schema)


def bit_sums(vectors: DataFrame, p: Params, doc: str = "doc_id") -> DataFrame:
    """(doc_id, tbl, s0, s1, ...): the dot products of sparse vectors (doc_id, pos, q), integer weights q, with all planes.
    Null weights don't count; a vector of nulls alone has null sums."""
    columns = ", ".join(f"s{b} long" for b in range(p.bits))
    return _each(vectors, p, doc, columns, lambda sums, weighed: [pa.array(sums[:, b], mask=~weighed) for b in range(p.bits)])


def grown(sums: DataFrame, more: DataFrame, p: Params, doc: str = "doc_id") -> DataFrame:
    """Dot products after vectors got further dimensions: those of the new dimensions alone are added."""
    return sums.unionByName(more).groupBy(doc, "tbl").agg(*[F.sum(f"s{b}").alias(f"s{b}") for b in range(p.bits)])


def bucket_of(sums: DataFrame, p: Params, doc: str = "doc_id") -> DataFrame:
    """(doc_id, tbl, bucket): a bit is set iff its dot product is at least 0."""
    total = sum((F.when(F.col(f"s{b}") >= 0, F.lit(1 << b)).otherwise(F.lit(0)) for b in range(p.bits)), F.lit(0))
    return sums.select(doc, "tbl", total.cast("int").alias("bucket"))


def signatures(vectors: DataFrame, p: Params, doc: str = "doc_id") -> DataFrame:
    """(doc_id, tbl, bucket) of sparse vectors (doc_id, pos, q) with integer weights q; documents without weights have no
    rows."""
    powers = 1 << np.arange(p.bits, dtype=np.int32)
    return _each(vectors, p, doc, "bucket int", lambda sums, weighed: [pa.array(((sums >= 0) & weighed[:, None]).astype(np.int32) @ powers)])


def kept(sigs: DataFrame, p: Params, order: str = "doc_id") -> DataFrame:
    """What the bounded buckets hold at the end: the latest ``capacity`` of each."""
    w = Window.partitionBy("tbl", "bucket").orderBy(F.desc(order))
    return sigs.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= p.capacity)


def query_then_insert(sigs: DataFrame, p: Params, order: str = "doc_id") -> DataFrame:
    """(doc_id, cand_id, tbl): for every arrival the up to ``capacity`` documents that its buckets held before it.

    A bucket of more than CROWDED arrivals is no window: its rows get gapless ranks and are cut into runs of that many,
    each with the ``capacity`` rows before it as halo, so one bucket of a third of all documents fills many tasks.
    """
    many = sigs.groupBy("tbl", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED).select("tbl", "bucket")
    w = Window.partitionBy("tbl", "bucket").orderBy(order).rowsBetween(-p.capacity, -1)
    if not many.limit(1).count():
        return _held(sigs, w)
    crowd = with_rank(sigs.join(many, ["tbl", "bucket"], "left_semi"), ["tbl", "bucket", order], "at")
    run = F.floor(F.col("at") / CROWDED)
    reached = F.when(F.col("at") % CROWDED >= CROWDED - p.capacity, F.array(run, run + 1)).otherwise(F.array(run))
    runs = crowd.select("*", F.posexplode(reached).alias("halo", "run"))
    return _held(sigs.join(many, ["tbl", "bucket"], "left_anti"), w).union(_held(runs, Window.partitionBy("run", "tbl", "bucket").orderBy("at").rowsBetween(-p.capacity, -1), "halo = 0"))


def _held(rows: DataFrame, w: WindowSpec, own: str = "true") -> DataFrame:
    return rows.withColumn("held", F.collect_list("doc_id").over(w)).filter(own).select("doc_id", "tbl", F.explode("held").alias("cand_id"))


def query_only(queries: DataFrame, sigs: DataFrame, p: Params) -> DataFrame:
    """(query_id, cand_id, tbl): what the queries' buckets hold."""
    held = kept(sigs, p).select(F.col("doc_id").alias("cand_id"), "tbl", "bucket")
    return queries.join(held, ["tbl", "bucket"]).select("query_id", "cand_id", "tbl")


def collisions(candidates: DataFrame, query: str = "query_id") -> DataFrame:
    return candidates.groupBy(query, "cand_id").agg(F.count(F.lit(1)).alias("n"))


def _code(p: Params) -> Column:
    return (F.col("tbl") * F.lit(1 << p.bits) + F.col("bucket")).cast("int").alias("code")


def _asking(scratch: Scratch, queries: DataFrame, p: Params) -> tuple[DataFrame, dict]:
    """(query_id, codes) and how many there are."""
    rows = queries.select(F.coalesce("query_id", F.lit(LEAST)).alias("query_id"), _code(p)).groupBy("query_id").agg(F.collect_list("code").alias("codes"))
    return scratch.counted(rows, "asking", n=F.count(F.lit(1)))


def _at(x: str, n: int) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(n)).cast("int")


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def counted(queries: DataFrame, sigs: DataFrame, rows: DataFrame, p: Params) -> DataFrame:
    """(query_id, n, columns of ``rows``): ``collisions`` of ``query_only``, with every row of ``rows`` (cand_id, ...) of the
    candidate, without moving a row a pair and table, or a pair to its candidate's row.

    What the buckets hold is put into its candidates' rows. These are cut into parts of about HELD entries, queries into
    slices of about COUNTING; every slice meets every part in a task, which passes on its pairs by blocks.
    """
    scratch = Scratch(sigs.sparkSession, "collisions")
    codes = kept(sigs, p).select(F.col("doc_id").alias("cand_id"), _code(p)).groupBy("cand_id").agg(F.collect_list("code").alias("codes"))
    held, h = scratch.counted(codes.join(rows, "cand_id"), "held", n=F.sum(F.size("codes")))
    asking, a = _asking(scratch, queries, p)
    parts, slices = max(1, -(-(h["n"] or 0) // HELD)), max(1, -(-a["n"] // COUNTING))
    left = held.withColumn("part", _at("cand_id", parts)).withColumn("slice", _every(slices))
    right = asking.withColumn("slice", _at("query_id", slices)).withColumn("part", _every(parts))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        asks = pc.is_valid(both["query_id"])
        held, asking = both.filter(pc.invert(asks)).combine_chunks(), both.filter(asks).combine_chunks()
        if not held.num_rows or not asking.num_rows:
            return
        own, cands, query = held["codes"].combine_chunks(), held.select(names), asking["query_id"].combine_chunks()
        local = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy(zero_copy_only=False))
        for q, cand, n in met(own.flatten().to_numpy(zero_copy_only=False), local, len(own), asking["codes"].combine_chunks()):
            found = cands.take(pa.array(cand)).combine_chunks()
            columns = [query.take(pa.array(q)), pa.array(n.astype(np.int64)), *[c.combine_chunks() for c in found.columns]]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "n", *names])

    schema = ", ".join(["query_id long, n long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]])
    found = left.unionByName(right, allowMissingColumns=True).groupBy("part", "slice").applyInArrow(run, schema)
    return found.withColumn("query_id", F.nullif("query_id", F.lit(LEAST)))


def top_collisions(queries: DataFrame, sigs: DataFrame, p: Params) -> DataFrame:
    """(query_id, cand_id, n, rank): the ``top_candidates`` by collisions of each query, ties to smaller ids, as ``top_n``
    of ``collisions`` of ``query_only`` gives them, without moving a row a pair and table.

    What the buckets hold is bounded (tables, buckets, capacity). It is cut by candidate into parts of about HELD entries,
    queries into slices of about ASKING; every slice meets every part in a task, which knows all collisions of its pairs
    and passes on the best of each query. Null ids travel as the least long.
    """
    scratch, least = Scratch(sigs.sparkSession, "collisions"), F.lit(LEAST)
    held, h = scratch.counted(kept(sigs, p).select(F.coalesce("doc_id", least).alias("cand_id"), _code(p)), "held", n=F.count(F.lit(1)))
    asking, a = _asking(scratch, queries, p)
    parts, slices = max(1, -(-h["n"] // HELD)), max(1, -(-a["n"] // ASKING))
    left = held.withColumn("part", _at("cand_id", parts)).withColumn("slice", _every(slices)).groupBy("part", "slice")
    right = asking.withColumn("slice", _at("query_id", slices)).withColumn("part", _every(parts)).groupBy("part", "slice")
    most = p.top_candidates

    def run(held: pa.Table, asking: pa.Table) -> pa.Table:
        return best_pairs(held, asking, most)

    found = left.cogroup(right).applyInArrow(run, "query_id long, cand_id long, n long")
    null = lambda x: F.nullif(F.col(x), least).alias(x)
    return top_n(found, most, "n").select(null("query_id"), null("cand_id"), "n", "rank")


def best_pairs(held: pa.Table, asking: pa.Table, most: int) -> pa.Table:
    """Of entries (cand_id, code) and queries (query_id, codes): (query_id, cand_id, n), n the codes in common, the
    ``most`` largest n of each query, ties to smaller ids."""
    ids, local = np.unique(held["cand_id"].to_numpy(), return_inverse=True)
    query, out = asking["query_id"].to_numpy(), []
    for q, cand, n in met(held["code"].to_numpy(), local, len(ids), asking["codes"].combine_chunks()):
        by = np.lexsort((-n, q))  # stable: candidates stay in order
        place = np.arange(len(by)) - np.searchsorted(q, q)  # q is in order
        by = by[place < most]
        out.append(pa.table({"query_id": query[q[by]], "cand_id": ids[cand[by]], "n": n[by].astype(np.int64)}))
    return pa.concat_tables(out) if out else pa.table({k: pa.array([], pa.int64()) for k in ("query_id", "cand_id", "n")})


def met(code: np.ndarray, local: np.ndarray, ids: int, lists: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Of entries (code, number of the candidate, below ``ids``) and the queries' lists of codes: numbers of queries and of
    candidates with how many codes they have in common, in order, about PAIRS entries of pairs at once."""
    order = np.argsort(code, kind="stable")
    code, local = code[order], local[order]
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    asked, owner = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
    first = np.searchsorted(code, asked, "left")
    times = np.searchsorted(code, asked, "right") - first
    upto = np.concatenate([[0], np.cumsum(times)])[np.concatenate([[0], np.cumsum(sizes)])]  # pairs before each query
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
        own = slice(int(ends[lo] - sizes[lo]), int(ends[hi - 1]))
        t = times[own]
        entry = np.repeat(first[own] - (np.cumsum(t) - t), t) + np.arange(int(t.sum()))
        pairs, n = np.unique(np.repeat(owner[own], t) * ids + local[entry], return_counts=True)
        yield pairs // max(1, ids), pairs % max(1, ids), n
        lo = hi


def top_n(rows: DataFrame, n: int, by: str, query: str = "query_id", tie: str = "cand_id", ascending: bool = False) -> DataFrame:
    """The n largest (or smallest) of each query in order, ties to smaller ids; column ``rank`` from 1."""
    w = Window.partitionBy(query).orderBy(F.asc(by) if ascending else F.desc(by), tie)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def bucket_sizes(sigs: DataFrame) -> DataFrame:
    return sigs.groupBy("tbl").agg(F.count_distinct("bucket").alias("buckets"), F.count(F.lit(1)).alias("rows"))


def sparse_cosine(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs with their cosine (cos_sim), from sparse vectors (query_id, pos, w) and (doc_id, pos, w); pairs without a
    common dimension have none and go. Only vectors of the pairs' documents are joined and measured."""
    near = pairs.select("query_id", "cand_id")
    own = docs.select(F.col("doc_id").alias("cand_id"), "pos", F.col("w").alias("dw")).join(near.select("cand_id").distinct(), "cand_id")
    q = queries.select("query_id", "pos", F.col("w").alias("qw"))
    met = near.join(q, "query_id").join(own, ["cand_id", "pos"]).groupBy("query_id", "cand_id").agg(F.sum(F.col("qw") * F.col("dw")).alias("dot"))
    dn = own.groupBy("cand_id").agg(F.sqrt(F.sum(F.col("dw") * F.col("dw"))).alias("dn"))
    return met.join(_norms(queries), "query_id").join(dn, "cand_id").select("query_id", "cand_id", _rounded())


def _norms(queries: DataFrame) -> DataFrame:
    return queries.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn"))


def _rounded() -> Column:
    """Cosines are rounded before they are ranked: sums of other orders give the same ranks."""
    return F.round(F.try_divide("dot", F.col("qn") * F.col("dn")), 6).alias("cos_sim")
