"""Vector bin packing of tokenized examples into training sequences.

Each example is a vector (tokens, segments, loss-bearing tokens). Within a window of examples a sequence is filled by
the dot-product heuristic: of all examples that still fit in every dimension, take the one whose demand has the
largest weighted dot product with what the sequence has left; a dimension's weight is its total demand. What remains
free is then filled by cutting examples of the emptiest sequences, and the one remainder is cut into sequences whose
lengths are powers of two, so that almost nothing is padded.

Examples are dealt to partitions by hash, packed in windows of bounded size, and each window is independent of all
others: no key is grouped, so no hot group exists, and a lost task is repeated with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlabel.llm.pieces import encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, loss_tokens long, sequence_id long, offset long, ids binary"


@dataclass(frozen=True)
class Limits:
    """tokens: of a sequence. segments, loss: most segments and loss-bearing tokens in a sequence. least_cut: shortest
    piece that is cut off to fill a sequence. window: tokens that are packed together (a task's memory).

    Plain documents bear loss on all tokens but their first, so ``loss`` decides only where prompts are named (see
    ``pack_documents``) or it is set below ``tokens``; then sequences may end before they are full."""

    tokens: int = 4096
    segments: int = 32
    loss: int = 4096
    least_cut: int = 16
    window: int = 4 << 20


def pack(demand: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The bin of each item (rows of demand). Equal vectors count as one kind, so a step costs the number of kinds."""
    if not len(demand):
        return np.zeros(0, np.int64)
    kinds, which = np.unique(-demand, axis=0, return_inverse=True)
    kinds, which = -kinds, which.ravel()  # largest first dimension first, so ties go to it
    queue = np.argsort(which, kind="stable")
    left = np.bincount(which, minlength=len(kinds))
    at = np.cumsum(left) - left
    share = kinds / capacity
    weight = (left[:, None] * share).sum(axis=0)
    bins, bin_no = np.full(len(demand), -1, np.int64), 0
    free, todo = capacity.astype(np.int64).copy(), len(demand)
    alive = np.arange(len(kinds))
    while todo:
        low = np.searchsorted(-kinds[alive, 0], -free[0])  # kinds are in falling order of the first dimension
        near = alive[low:]
        fits = near[(kinds[near, 1:] <= free[1:]).all(axis=1)] if len(near) else near
        if len(fits):
            k = fits[np.argmax(share[fits] @ (weight * free / capacity))]
            bins[queue[at[k]]] = bin_no
            at[k] += 1
            left[k] -= 1
            free -= kinds[k]
            todo -= 1
            if not left[k]:
                alive = alive[left[alive] > 0]
        if not len(fits) or not free[0]:
            bin_no += 1
            free = capacity.astype(np.int64).copy()
    return bins


def loss_of(start: int, end: int, bare: int) -> int:
    """Loss-bearing ids among a document's ids from start to end, of which the first ``bare`` bear none."""
    return max(0, end - max(start, bare))


def fill(lengths: np.ndarray, bare: np.ndarray, bins: np.ndarray, limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, from, to): packed bins, topped up by cutting the items of the emptiest bins.

    bare: ids at an item's beginning that bear no loss."""
    n = int(bins.max()) + 1 if len(bins) else 0
    seqs: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    for i in np.argsort(bins, kind="stable"):
        seqs[bins[i]].append((int(i), 0, int(lengths[i])))
    used = np.bincount(bins, lengths, n).astype(np.int64)
    loss_used = np.bincount(bins, np.maximum(lengths - bare, 0), n).astype(np.int64)
    order = list(np.argsort(-used, kind="stable"))
    done: list[list[tuple[int, int, int]]] = []
    donor: list[tuple[int, int, int]] = []
    lo, hi = 0, len(order)
    while lo < hi:
        b = order[lo]
        lo += 1
        room, loss_room = int(limits.tokens - used[b]), int(limits.loss - loss_used[b])
        seq = seqs[b]
        while room >= limits.least_cut and len(seq) < limits.segments:
            if not donor:
                if lo >= hi:
                    break
                hi -= 1
                donor = seqs[order[hi]]
            i, a, z = donor[-1]
            take = min(room, z - a, max(0, int(bare[i]) - a) + loss_room)
            if take < min(limits.least_cut, z - a):
                break
            donor.pop()
            if z - a - take:
                donor.append((i, a + take, z))
            seq.append((i, a, a + take))
            room -= take
            loss_room -= loss_of(a, a + take, int(bare[i]))
        done.append(seq)
    if donor:
        done.append(donor)
    return done


def powers(seq: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """One sequence cut into sequences whose lengths are the powers of two of its length."""
    total, out, rest = sum(z - a for _, a, z in seq), [], list(seq)
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            need, part = 1 << bit, []
            while need:
                i, a, z = rest.pop(0)
                take = min(need, z - a)
                part.append((i, a, a + take))
                need -= take
                if a + take < z:
                    rest.insert(0, (i, a + take, z))
            out.append(part)
    return out


def _cut(vocabulary_path: str, end_id: int, limits: Limits):
    """Documents to pieces of at most one sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path)
        for batch in batches:
            doc, text, prompt = batch.columns
            for lo in range(0, batch.num_rows, 1024):
                flat, counts = enc.ids(text.slice(lo, 1024).to_pylist())
                heads = enc.counts(prompt.slice(lo, 1024).to_pylist()) if prompt.null_count < len(prompt) else np.zeros(len(counts), np.int64)
                rows: dict[str, list] = {n: [] for n in _PIECE_SCHEMA.names}
                at = 0
                for key, n, bare in zip(doc.slice(lo, 1024).to_pylist(), counts.tolist(), np.maximum(heads, 1).tolist(), strict=True):
                    ids = np.append(flat[at : at + n], np.array([end_id], enc.dtype))
                    at += n
                    start = 0
                    while start <= n:  # no piece is over a limit by itself
                        piece = ids[start : min(start + limits.tokens, max(start, bare) + limits.loss)]
                        rows["doc_id"].append(key), rows["start"].append(start), rows["length"].append(len(piece))
                        rows["doc_tokens"].append(n + 1), rows["bare"].append(bare), rows["ids"].append(piece.tobytes())
                        start += len(piece)
                yield pa.RecordBatch.from_pydict(rows, schema=_PIECE_SCHEMA)

    return run


_PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("bare", pa.int64()), ("ids", pa.binary())])
_OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "loss_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


def _pack(vocabulary_path: str, limits: Limits):
    """Pieces of a partition, in a fixed order, to sequences, window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(vocabulary_path).dtype
        base, made = TaskContext.get().partitionId() << 40, 0
        capacity = np.array([limits.tokens, limits.segments, limits.loss], np.int64)
        window: list[tuple[int, int, int, int, bytes]] = []
        size = 0

        def rows(seqs, items) -> pa.RecordBatch:
            nonlocal made
            cols: list[list] = [[] for _ in range(8)]
            for seq in seqs:
                offset = 0
                for i, a, z in seq:
                    doc, start, total, bare, raw = items[i]
                    ids = np.frombuffer(raw, dtype)[a:z].astype("<u4").tobytes()
                    for c, v in zip(cols, (doc, start + a, z - a, total, loss_of(start + a, start + z, bare), base + made, offset, ids), strict=True):
                        c.append(v)
                    offset += z - a
                made += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _OUT, strict=True)], schema=_OUT)

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal window, size
            lengths = np.array([len(x[4]) // dtype.itemsize for x in window], np.int64)
            bare = np.array([max(0, x[3] - x[1]) for x in window], np.int64)
            loss = np.maximum(lengths - bare, 0)
            bins = pack(np.stack([lengths, np.ones_like(lengths), loss], axis=1), capacity)
            seqs = fill(lengths, bare, bins, limits)
            rest = []
            if seqs and (total := sum(z - a for _, a, z in seqs[-1])) & (total - 1) and total < limits.tokens:
                rest = seqs.pop()
            if last and rest:
                seqs += powers(rest)
                rest = []
            for lo in range(0, len(seqs), 256):
                yield rows(seqs[lo : lo + 256], window)
            itemsize = dtype.itemsize
            window = [(d, s + a, t, bare, raw[a * itemsize : z * itemsize]) for (d, s, t, bare, raw), a, z in ((window[i], a, z) for i, a, z in rest)]
            size = sum(len(x[4]) // itemsize for x in window)

        for batch in batches:
            for piece in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "start", "doc_tokens", "bare", "ids")), strict=True):
                window.append(piece)
                size += len(piece[4]) // dtype.itemsize
                if size >= limits.window:
                    yield from packed(last=False)
        if window:
            yield from packed(last=True)

    return run


def pack_documents(df: DataFrame, vocabulary_path: str, end_id: int = 2, limits: Limits | None = None, text: str = "text", key: str = "doc_id", prompt: str | None = None) -> DataFrame:
    """Every document's ids (``end_id`` appended) in sequences of at most ``limits.tokens`` ids; one row a piece.

    ``prompt`` names a column with the beginning of the text that bears no loss (instruction data); as many ids as the
    prompt has by itself bear none, at least one: a document's first id has nothing that predicts it.

    A piece: doc_id, start (its document's ids before it), length, doc_tokens, loss_tokens, sequence_id, offset in the sequence (gapless from 0), ids (unsigned 32-bit, little
    endian). Each id lies in exactly one piece. A sequence that is shorter than the limit is to be padded to it, unless
    its length is a power of two. Null text: the end id alone. Null and repeated keys are packed like any others; the
    empty table gives no rows; extra columns are dropped.
    """
    limits = limits or Limits()
    if limits.loss < 1 or limits.segments < 1:
        raise ValueError("limits must be positive")
    head = F.col(prompt) if prompt else F.lit(None).cast("string")
    pieces = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), head.alias("prompt")).mapInArrow(
        _cut(vocabulary_path, end_id, limits), "doc_id long, start long, length long, doc_tokens long, bare long, ids binary"
    )
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(n, F.xxhash64("doc_id", "start", "doc_tokens", F.crc32("ids"))).sortWithinPartitions("doc_id", "start", "length", "ids")
    return dealt.mapInArrow(_pack(vocabulary_path, limits), PIECES)
