"""Token ids in files of static range asymmetric numeral systems (rANS) blocks.

One frequency table, counted over the whole corpus and scaled to 2**20, is shared by all blocks. A block codes up to
``BLOCK`` ids of consecutive documents with ``LANES`` interleaved states (id i belongs to lane i mod LANES; a state lies
in [2**31, 2**63) and gives up 32-bit words), so numpy codes a whole step of lanes at once. A block needs nothing but
the table: its header has a checkpoint every ``STEPS`` steps (all lane states and the place in the words) and a crc32 of
the ids between two checkpoints, so each such segment can be decoded and proved by itself, in parallel.

Files: ``<out>/table`` (id, freq) and ``<out>/blocks`` (one row a block, in Parquet as container, because that is what
Spark writes and commits safely on any store; ``payload`` is the coded block as laid out by ``encode_block``).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearlabel.llm.pieces import encoder

BITS, LANES, STEPS, BLOCK = 20, 1024, 128, 1 << 18
#: Bytes of ids in a batch of rows.
SLICE = 1 << 30
LOW = np.uint64(1 << 31)
_HEADER = struct.Struct("<4sBIIQQI")
_MAGIC = b"rANS"


class Table:
    """Scaled frequencies and their sums; the decoder's slots are built when first needed."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        size = int(ids.max()) + 1 if len(ids) else 0
        self.freq = np.zeros(size, np.uint64)
        self.freq[ids] = freq.astype(np.uint64)
        self.below = np.cumsum(self.freq) - self.freq
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**BITS, each at least 1; what rounding leaves over goes to the largest."""
    total, goal = int(counts.sum()), 1 << BITS
    if len(counts) > goal:
        raise ValueError("more distinct ids than slots")
    freq = np.maximum(1, (counts.astype(np.float64) * goal / total).astype(np.int64))
    for i in np.argsort(-freq, kind="stable"):
        spare = goal - int(freq.sum())
        if not spare:
            break
        freq[i] += max(spare, 1 - int(freq[i]))
    return freq


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """header | checkpoints: word place u64, crc32 u32 each | lane states u64 of each checkpoint | words u32"""
    n = len(ids)
    steps = -(-n // LANES)
    freq, below = table.freq[ids], table.below[ids]
    top = freq << np.uint64(63 - BITS)
    state = np.full(LANES, LOW, np.uint64)
    chunks, emitted, marks = [], 0, []
    for t in range(steps - 1, -1, -1):
        part = slice(t * LANES, min(n, (t + 1) * LANES))
        f = freq[part]
        x = state[: len(f)]
        over = np.flatnonzero(x >= top[part])
        if len(over):
            full = x[over]
            chunks.append(full.astype("<u4"))  # keeps the low 32 bits
            emitted += len(over)
            x[over] = full >> np.uint64(32)
        q = x // f
        state[: len(f)] = (q << np.uint64(BITS)) + (x - q * f) + below[part]
        if t % STEPS == 0:
            marks.append((t, emitted, state.copy()))
    marks.reverse()
    chunks.reverse()
    span = STEPS * LANES
    raw = ids.astype("<u4")
    out = [_HEADER.pack(_MAGIC, BITS, LANES, STEPS, n, emitted, len(marks))]
    out += [struct.pack("<QI", emitted - after, zlib.crc32(raw[k * span : (k + 1) * span].tobytes())) for k, (_, after, _) in enumerate(marks)]
    out += [state.astype("<u8").tobytes() for _, _, state in marks]
    return b"".join(out + [c.tobytes() for c in chunks])


def segments(payload: bytes) -> int:
    return _HEADER.unpack_from(payload)[6]


def decode_segment(payload: bytes, table: Table, k: int) -> np.ndarray:
    """The ids between checkpoint k and the next one; raises where the crc32 differs."""
    magic, bits, lanes, every, n, n_words, count = _HEADER.unpack_from(payload)
    if magic != _MAGIC or bits != BITS:
        raise ValueError("not a block of this format")
    place, crc = struct.unpack_from("<QI", payload, _HEADER.size + 12 * k)
    at = _HEADER.size + 12 * count
    x = np.frombuffer(payload, "<u8", lanes, at + 8 * lanes * k).copy()
    words = np.frombuffer(payload, "<u4", n_words, at + 8 * lanes * count)
    first, last = k * every * lanes, min(n, (k + 1) * every * lanes)
    out = np.empty(last - first, np.uint32)
    mask, slots, freq, below = np.uint64((1 << BITS) - 1), table.slots, table.freq, table.below
    for lo in range(0, last - first, lanes):
        m = min(lanes, last - first - lo)
        state = x[:m]
        slot = state & mask
        s = slots[slot]
        out[lo : lo + m] = s
        state = freq[s] * (state >> np.uint64(BITS)) + slot - below[s]
        need = np.flatnonzero(state < LOW)
        if len(need):
            state[need] = (state[need] << np.uint64(32)) | words[place : place + len(need)]
            place += len(need)
        x[:m] = state
    if zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError(f"segment {k}: the checksum differs")
    return out


def cut_segment(payload: bytes, k: int) -> bytes:
    """The block that holds segment k alone: its checkpoint and the words up to the next one."""
    magic, bits, lanes, every, n, n_words, count = _HEADER.unpack_from(payload)
    marks = [struct.unpack_from("<QI", payload, _HEADER.size + 12 * j) for j in range(k, min(count, k + 2))]
    (place, crc), after = marks[0], marks[1][0] if len(marks) > 1 else n_words
    at, span = _HEADER.size + 12 * count, every * lanes
    states, words = payload[at + 8 * lanes * k : at + 8 * lanes * (k + 1)], at + 8 * lanes * count
    head = _HEADER.pack(magic, bits, lanes, every, min(n - k * span, span), after - place, 1)
    return head + struct.pack("<QI", 0, crc) + states + payload[words + 4 * place : words + 4 * after]


def decode_block(payload: bytes, table: Table) -> np.ndarray:
    return np.concatenate([decode_segment(payload, table, k) for k in range(segments(payload))])


def _tokens(path: str, end_id: int):
    """doc_id and ids of every document; one more row a task, without ids, holds the task's counts of ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        total = np.zeros(0, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                docs = batch.column(0).slice(lo, 1024)
                flat, counts = enc.ids(batch.column(1).slice(lo, 1024).to_pylist())
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, np.array(end_id, enc.dtype))
                got = np.bincount(flat)
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
                total[: len(got)] += got
                ends = np.concatenate([[0], (ends + np.arange(1, len(ends) + 1)) * enc.dtype.itemsize])
                raw, a = flat.view(np.uint8), 0
                while a < len(docs):  # offsets are 32-bit: a batch holds less than SLICE bytes of ids, or one document
                    z = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE)) - 1)
                    offsets = pa.py_buffer((ends[a : z + 1] - ends[a]).astype(np.int32))
                    ids = pa.Array.from_buffers(pa.binary(), z - a, [None, offsets, pa.py_buffer(raw[ends[a] : ends[z]])])
                    yield pa.RecordBatch.from_arrays([docs.slice(a, z - a).cast(pa.int64()), ids, pa.nulls(z - a, pa.binary())], schema=schema)
                    a = z
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([total.tobytes()], pa.binary())], schema=schema)

    return run


def _sum_counts(t: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in t:
        for raw in batch.column(0).to_pylist():
            got = np.frombuffer(raw, np.int64)
            if len(got) > len(total):
                total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
            total[: len(got)] += got
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


_BLOCKS = "part int, local_start long, n_ids long, spanning boolean, doc_ids array<long>, doc_tokens array<long>, piece_starts array<long>, payload binary"
_BLOCK_SCHEMA = pa.schema(
    [("part", pa.int32()), ("local_start", pa.int64()), ("n_ids", pa.int64()), ("spanning", pa.bool_())]
    + [(n, pa.list_(pa.int64())) for n in ("doc_ids", "doc_tokens", "piece_starts")]
    + [("payload", pa.binary())]
)


def _encode(itemsize: int, shared):
    """A partition's documents, in order, to blocks. A document that is longer than a block gets blocks of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        part, at = TaskContext.get().partitionId(), 0
        docs: list[tuple[int, int, int]] = []
        held: list[np.ndarray] = []
        size = 0

        def block(spanning: bool) -> pa.RecordBatch:
            nonlocal at, docs, held, size
            ids = np.concatenate(held)
            row = [part, at, len(ids), spanning, *[list(c) for c in zip(*docs, strict=True)], encode_block(ids, table)]
            at += len(ids)
            docs, held, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _BLOCK_SCHEMA, strict=True)], schema=_BLOCK_SCHEMA)

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, f"<u{itemsize}")
                if size and size + len(ids) > BLOCK:
                    yield block(False)
                for start in range(0, len(ids), BLOCK):
                    docs.append((doc, len(ids), start))
                    held.append(ids[start : start + BLOCK])
                    size += len(held[-1])
                    if len(ids) > BLOCK:
                        yield block(True)
        if size:
            yield block(False)

    return run


def write_ids(df: DataFrame, vocabulary_path: str, out: str, end_id: int = 2, text: str = "text", key: str = "doc_id") -> None:
    """Write all documents' ids, ``end_id`` appended to each, in ascending key order (nulls first, repeated keys side by
    side). Null text: the end id alone. An empty table gives an empty table and no blocks.

    One shuffle, of ids as 16-bit integers where the vocabulary allows; the text is tokenized once. The shared table has
    one row an id of the vocabulary, which bounds what goes through the driver.
    """
    spark = df.sparkSession
    itemsize = encoder(vocabulary_path).dtype.itemsize
    tokens = f"{out}/tokens"
    df.select(F.col(key).cast("long"), F.col(text)).mapInArrow(_tokens(vocabulary_path, end_id), "doc_id long, ids binary, counts binary").write.option(
        "compression", "zstd"
    ).mode("overwrite").parquet(tokens)
    coded = spark.read.schema("doc_id long, ids binary, counts binary").parquet(tokens)
    counts = coded.select("counts").filter("counts IS NOT NULL").mapInArrow(_sum_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    freq = scaled(counts["n"].to_numpy()) if len(counts) else np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast((counts["id"].to_numpy(np.int64), freq))
    table = spark.createDataFrame([(int(i), int(f)) for i, f in zip(counts["id"], freq, strict=True)], "id long, freq long")
    table.coalesce(1).write.mode("overwrite").parquet(f"{out}/table")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.filter("ids IS NOT NULL").select("doc_id", "ids").withColumn("h", F.xxhash64("ids")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "ids").drop("h")
    ordered.mapInArrow(_encode(itemsize, shared), _BLOCKS).write.option("compression", "none").mode("overwrite").parquet(f"{out}/blocks")
    remove(spark, tokens)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _decode(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("piece_start", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                base, payload, docs, totals, begins = (batch.column(i)[k].as_py() for i in range(5))
                ids = decode_block(payload, table).astype("<u4").tobytes()
                n = [min(t - b, BLOCK) for t, b in zip(totals, begins, strict=True)]
                ends = np.cumsum(n)
                starts = ends - n
                # a document starts before its piece by what earlier blocks hold of it
                cols = [docs, (base + starts - np.array(begins)).tolist(), totals, begins, [ids[4 * a : 4 * z] for a, z in zip(starts, ends, strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    return run


def _opened(spark: SparkSession, out: str):
    """The shared table, and the blocks with ``base``, the ids of all blocks before them."""
    table = spark.read.parquet(f"{out}/table").orderBy("id").toPandas()
    shared = spark.sparkContext.broadcast((table["id"].to_numpy("int64"), table["freq"].to_numpy("int64")))
    blocks = spark.read.parquet(f"{out}/blocks")
    sums = {r[0]: r[1] for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect()}
    parts = sorted(sums)
    before = dict(zip(parts, [0, *np.cumsum([sums[p] for p in parts]).tolist()], strict=False))
    bases = spark.createDataFrame([(p, b) for p, b in before.items()], "part int, before long")
    return shared, blocks.join(F.broadcast(bases), "part").withColumn("base", F.col("before") + F.col("local_start"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (start, payload) of blocks (base, payload, k)."""
    for batch in batches:
        for base, payload, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([base + k * STEPS * LANES]), pa.array([cut_segment(payload, k)], pa.binary())], names=["start", "payload"])


def _decode_segments(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for batch in batches:
            for start, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([decode_block(payload, table).astype("<u4").tobytes()], pa.binary())], names=["start", "ids"])

    return run


def read_range(spark: SparkSession, out: str, first: int, last: int) -> DataFrame:
    """(start, ids) of the segments that hold the ids ``first`` to ``last`` - 1 of the whole corpus: only these are taken
    out of their blocks, and each is dealt to a task and decoded from its own checkpoint. Ids are unsigned 32-bit, little
    endian; a segment may begin before ``first`` and end after ``last``. An empty range has no rows."""
    shared, placed = _opened(spark, out)
    span, here = STEPS * LANES, F.least(F.lit(last) - F.col("base"), F.col("n_ids"))
    hit = placed.filter((F.col("base") < last) & (F.col("base") + F.col("n_ids") > first) & F.lit(first < last))
    wanted = F.sequence(F.floor(F.greatest(F.lit(first) - F.col("base"), F.lit(0)) / span), F.floor((here - 1) / span))
    cut = hit.select("base", "payload", F.explode(wanted).alias("k")).mapInArrow(_cut, "start long, payload binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(n, "start").mapInArrow(_decode_segments(shared), "start long, ids binary")


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit, little endian).

    Blocks are decoded independently. Only documents that are longer than a block meet in a group, their own pieces.
    Where a block begins among all ids follows from one sum a partition of the writer.
    """
    shared, placed = _opened(spark, out)
    placed = placed.select("base", "payload", "doc_ids", "doc_tokens", "piece_starts", "spanning")
    columns = ["base", "payload", "doc_ids", "doc_tokens", "piece_starts"]
    schema = "doc_id long, start long, doc_tokens long, piece_start long, ids binary"
    whole = placed.filter(~F.col("spanning")).select(columns).mapInArrow(_decode(shared), schema)
    pieces = placed.filter("spanning").select(columns).mapInArrow(_decode(shared), schema)
    joined = pieces.groupBy("doc_id", "start", "doc_tokens").agg(
        F.array_sort(F.collect_list(F.struct("piece_start", "ids"))).alias("p")
    ).select("doc_id", "start", F.col("doc_tokens").alias("n_tokens"), F.aggregate(F.transform("p", lambda x: x["ids"]), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
    return whole.select("doc_id", "start", F.col("doc_tokens").alias("n_tokens"), "ids").unionByName(joined)
