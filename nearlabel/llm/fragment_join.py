"""Jaccard self-join of documents by word n-grams, with vertical partitioning.

A document is the set of 64-bit hashes of its distinct n-grams. Sets of equal content are one class, whatever the number
of copies. All grams have one global order: rare ones first, then by hash. How rare a gram is tells a table of counts of
all documents' grams (``SLOTS`` slots, each with the eighth of a power of two that its count reaches), so that lines which
many documents share come last. The order is cut into fragments twice.

Candidates: two sets of at least the asked similarity share a gram among the first |s| - ceil(t |s|) + 1 of each, whatever
the order. So these first fragments of all classes make an index, and classes that share a key are candidates. No pair is
missed, and no bucket is capped; the table of counts decides nothing but how many there are.

Overlaps: the order is cut into ``FRAGMENTS`` fragments of about equal content; overlaps of candidates are counted
fragment by fragment, each in its own row, and summed per pair.

Marks: each class has a bit table in which every gram flips one bit (twice its set's size, a power of two). Two tables
differ in no more bits than the sets do in grams, so candidates whose tables differ in more than the similarity allows
are none, and no pair is lost; what is left are near copies, apart from few.

A bucket of N classes is not expanded into pairs. First each class is held against one other, the least class of that of
its buckets which it shares most often, by marks. Buckets that then still lie in several groups are searched by marks:
members of different groups in turn, in blocks of bounded size where a bucket is crowded, and a task puts out a spanning
forest of what it found. The groups that result are small clusters of near copies, whose sets alone are moved. In a
cluster, each class is held against one other by sets, and links make components; then a cluster in several components is
cut into blocks of bounded size, and a task holds two blocks against each other: overlaps are products of 0/1 matrices,
again fragment by fragment and summed, pairs within the cluster's largest component are left out, and what leaves a task
is a spanning forest of its links. So every pair that shares a key is decided, and no list of pairs is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearlabel.llm import forget
from nearlabel.operators.graph import Scratch, connected_components

#: Fragments for the overlaps; bits of the tables that tell which keys and sets are needed again; most sets and (on
#: average) hashes of a block; columns of a matrix.
FRAGMENTS, BITS, BLOCK, WEIGHT, COLUMNS = 8, 1 << 26, 1024, 1 << 20, 2048
#: Slots of the table of counts, which is broadcast as a byte each; rows it is summed up in; partial sums of a row.
SLOTS, CHUNKS, SALTS = 1 << 22, 16, 16
#: Fewest bits of a mark; members of a bucket up to which they are compared one by one.
MARK, FEW = 256, 64
#: Bytes and rows hashed at once; classes that a task remembers to have put out.
PART_BYTES, ROWS, SEEN = 1 << 19, 512, 100_000

_U = np.uint64
#: The hash function: odd multipliers and a table of a number for each byte, drawn once from a fixed seed.
_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as needed so far."""

    size = 0

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.size < n:
            one = np.full(n, _BASE, np.uint64)
            back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            one[0] = back[0] = 1
            cls.up, cls.down, cls.size = np.cumprod(one), np.cumprod(back), n
        return cls.up, cls.down


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a byte string: differences of prefix sums of a polynomial."""
    b = np.frombuffer(data, np.uint8)
    up, down = _Powers.upto(max(len(b) + 1, PART_BYTES))
    word = np.concatenate([[False], ~_SPACE[b], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    start, end = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)])])
    return _mix((sums[end] - sums[start]) * down[start] + _U(1)), start


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes and each text's number of words. Long texts are cut between words."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    part: list[tuple[int, bytes]] = []
    size = 0

    def run() -> None:
        ends = np.cumsum([len(x) + 1 for _, x in part])
        h, start = _word_hashes(b" ".join(x for _, x in part))
        own = np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(part))
        np.add.at(counts, [k for k, _ in part], own)
        hashes.append(h)

    for k, text in enumerate(texts):
        while text:
            piece = text
            if len(text) > PART_BYTES:
                space = _SPACE[np.frombuffer(text, np.uint8)[PART_BYTES:]]
                at = PART_BYTES + int(space.argmax()) if space.any() else len(text)
                piece = text[:at]
            part.append((k, piece))
            size += len(piece)
            text = text[len(piece) :]
            if size >= PART_BYTES:
                run()
                part, size = [], 0
    if part:
        run()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def sets_of(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after another, and their numbers. A text of fewer words is one
    gram of all of them; no words, no gram."""
    h, m = _words([(t or "").encode("utf-8") for t in texts])
    first = np.cumsum(m) - m
    grams = np.zeros(len(h), np.uint64)
    for j in range(n):
        grams[: max(0, len(h) - j)] += h[j:] * _STEP[j]
    doc = np.repeat(np.arange(len(m)), m)
    inside = np.arange(len(h)) - first[doc] + n <= m[doc]
    short = np.flatnonzero((m > 0) & (m < n))
    few = np.zeros(len(short), np.uint64)
    for j in range(n - 1):
        has = m[short] > j
        few[has] += h[first[short[has]] + j] * _STEP[j]
    grams = _mix(np.concatenate([grams[inside], few + _U(0xC0FFEE) * m[short].astype(np.uint64)]))
    doc = np.concatenate([doc[inside], short])
    order = _by(doc, [(grams, 64)], len(m))
    grams, doc = grams[order], doc[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[keep], np.bincount(doc[keep], minlength=len(m)).astype(np.int64)


def _by(doc: np.ndarray, keys: list[tuple[np.ndarray, int]], docs: int) -> np.ndarray:
    """The order by document (below ``docs``) and keys (values, bits). Sorted as one 64-bit number each, which is many
    times faster; rows that it can't tell apart are rare, and then all are sorted by whole keys."""
    left = 64 - docs.bit_length()
    number = doc.astype(np.uint64) << _U(left)
    for values, bits in keys:
        left -= bits
        values = values.astype(np.uint64)
        number |= values << _U(left) if left >= 0 else values >> _U(-left)
        if left <= 0:
            break
    order = np.argsort(number)
    same = np.flatnonzero(number[order][1:] == number[order][:-1])
    if any((v[order[same]] != v[order[same + 1]]).any() for v, _ in keys):
        return np.lexsort([v for v, _ in reversed(keys)] + [doc])
    return order


def _class_ids(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(grams + _U(0x77)))])
    return _mix((sums[ends] - sums[ends - sizes]) ^ _mix(sizes.astype(np.uint64))).view(np.int64)


_SURVEY = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])
_INDEX = pa.schema([("key", pa.int64()), ("cid", pa.int64()), ("n", pa.int64()), ("mark", pa.list_(pa.int64()))])
_SETS = pa.schema([("cid", pa.int64()), ("frag", pa.int32()), ("grams", pa.list_(pa.int64()))])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (with a column ``text``) in slices of at most ROWS rows and about PART_BYTES bytes of text, or one row."""
    forget()
    for batch in batches:
        upto = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64))])
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(upto, upto[lo] + PART_BYTES, side="right")) - 1
            hi = min(max(hi, lo + 1), lo + ROWS, batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> _U(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts byte by byte, so that the high ones, mostly zero, lie together."""
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _survey(n: int):
    """Of each document the size of its set and its class; then the task's counts of grams by slot, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint32)
        for batch in _slices(batches):
            grams, sizes = sets_of(batch.column(1).to_pylist(), n)
            at, times = np.unique(_slot(grams), return_counts=True)
            total[at] += times.astype(np.uint32)
            nulls = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes), pa.array(_class_ids(grams, sizes)), *nulls], schema=_SURVEY)
        for k, part in enumerate(np.split(total, CHUNKS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([k], pa.int32()), pa.array([_packed(part)], pa.binary())], schema=_SURVEY)

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a chunk (chunk, salt, counts), summed up."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for chunk, salt, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total[chunk, salt] = total[chunk, salt] + _unpacked(raw) if (chunk, salt) in total else _unpacked(raw)
    for (chunk, salt), counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([salt], pa.int32()), pa.array([_packed(counts)], pa.binary())], names=["chunk", "salt", "counts"])


def _steps(counts: np.ndarray) -> np.ndarray:
    """The eighth of a power of two that a count reaches, at most 255."""
    return np.minimum(255, np.log2(np.maximum(counts, 1)) * 8).astype(np.uint8)


class Order:
    """The global order of grams: the step of a gram's slot, then the gram. ``cuts``: its fragments' first numbers."""

    def __init__(self, steps: np.ndarray, weight: np.ndarray):
        self.steps = steps
        upto = np.concatenate([[0], np.cumsum(weight)])
        goal = upto[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS
        step = np.minimum(np.searchsorted(upto, goal, side="right") - 1, 255)
        share = np.divide(goal - upto[step], weight[step], out=np.zeros(len(step)), where=weight[step] > 0)
        self.cuts = (step.astype(np.uint64) << _U(56)) + (np.minimum(share, 0.999) * 2.0**56).astype(np.uint64)

    def step(self, grams: np.ndarray) -> np.ndarray:
        return self.steps[_slot(grams)]

    def fragment(self, grams: np.ndarray) -> np.ndarray:
        number = (self.step(grams).astype(np.uint64) << _U(56)) + (grams >> _U(8))
        return np.searchsorted(self.cuts, number, side="right")


def _order(spark: SparkSession, survey: DataFrame):
    """The order, from all tasks' counts: one byte a slot reaches the driver, whatever the number of documents."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "chunk int, salt int, counts binary"
    counts = survey.filter("chunk IS NOT NULL").select("chunk", F.pmod(F.xxhash64("counts"), F.lit(SALTS)).cast("int").alias("salt"), "counts")
    counts = counts.repartition(n, "chunk", "salt").mapInArrow(_sum_counts, schema).select("chunk", F.lit(0).alias("salt"), "counts")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sum_counts(batches):
            whole = _unpacked(batch.column(2)[0].as_py())
            steps = _steps(whole)
            weight = np.bincount(steps, whole, 256)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([steps.tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary())], names=["chunk", "steps", "weight"])

    rows = counts.repartition(n, "chunk").mapInArrow(finished, "chunk int, steps binary, weight binary").collect()
    steps, weight = np.zeros((CHUNKS, SLOTS // CHUNKS), np.uint8), np.zeros(256)
    for r in rows:
        steps[r.chunk] = np.frombuffer(r.steps, np.uint8)
        weight += np.frombuffer(r.weight)
    return spark.sparkContext.broadcast(Order(steps.ravel(), weight))


def firsts(grams: np.ndarray, sizes: np.ndarray, order: Order, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The first |s| - ceil(num |s| / den) + 1 grams of each set in the order, set by set, and their numbers."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    step = order.step(grams)
    grams = grams[_by(doc, [(step, 8), (grams, 64)], len(sizes))]
    counts = np.where(sizes > 0, sizes + (-sizes * num // den) + 1, 0)
    return grams[np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(counts, sizes)], counts


def _new(cid: np.ndarray, seen: set[int]) -> np.ndarray:
    """Whether a class has not been put out before, as far as a task remembers."""
    new = np.zeros(len(cid), bool)
    for k, c in enumerate(cid.tolist()):
        if c not in seen:
            seen.add(c)
            new[k] = True
    if len(seen) > SEEN:
        seen.clear()
    return new


def marks(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets' bit tables, one after another, and their numbers of 64-bit words."""
    bits = np.maximum(MARK, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
    words = bits // 64
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = (grams & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    out = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(out, (np.cumsum(words) - words)[doc] + (place >> 6), _U(1) << (place & 63).astype(np.uint64))
    return out, words


def _index(n: int, num: int, den: int, order):
    """Of each class, once a task: key, class and size of its set for each of its first grams, and a row with its mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            grams, sizes = sets_of(batch.column(0).to_pylist(), n)
            cid = _class_ids(grams, sizes)
            keys, counts = firsts(grams, sizes, order.value, num, den)
            new = _new(cid, seen)
            use = np.repeat(new, counts)
            cols = keys.view(np.int64), np.repeat(cid, counts), np.repeat(sizes, counts)
            yield pa.RecordBatch.from_arrays([*[pa.array(c[use]) for c in cols], pa.nulls(int(use.sum()), _INDEX.field(3).type)], schema=_INDEX)
            new &= sizes > 0
            words, m = marks(grams[np.repeat(new, sizes)], sizes[new])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(m)]), pa.int32()), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(m), pa.int64()), pa.array(cid[new]), pa.array(sizes[new]), lists], schema=_INDEX)

    return run


def _marked(table, ids: np.ndarray) -> np.ndarray:
    """Whether ids have their bit in a table of ``_bits``."""
    place = (ids.view(np.uint64) & _U(BITS - 1)).astype(np.int64)
    return (table[place >> 6] >> (place & 63).astype(np.uint64) & _U(1)).astype(bool)


def _where_marked(table):
    """The rows whose first column has its bit in the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_marked(table.value, np.asarray(batch.column(0)))))

    return run


def _needed(n: int, table, order):
    """The sets, in fragments, of the documents whose class has its bit in the table; a class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            grams, sizes = sets_of(batch.column(0).to_pylist(), n)
            cid = _class_ids(grams, sizes)
            want = np.flatnonzero(_marked(table.value, cid) & (sizes > 0))
            begin = np.cumsum(sizes) - sizes
            rows: list[list] = [[], [], []]
            for k in want[_new(cid[want], seen)].tolist():
                own = grams[begin[k] : begin[k] + sizes[k]]
                frag = order.value.fragment(own)
                for f in range(FRAGMENTS):
                    if (part := own[frag == f]).size:
                        rows[0].append(int(cid[k])), rows[1].append(f), rows[2].append(part.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(rows, _SETS, strict=True)], schema=_SETS)

    return run


def _bits(spark: SparkSession, ids: DataFrame):
    """A broadcast table of BITS bits in which each id (the one column) has its bit set: a fixed size, whatever the number
    of ids. Sixteen bytes for 64 bits reach the driver."""
    place = F.col(ids.columns[0]).bitwiseAND(F.lit(BITS - 1))
    rows = ids.groupBy(F.shiftright(place, 6).alias("k")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))).alias("b")).toArrow()
    table = np.zeros(BITS // 64, np.uint64)
    table[rows.column("k").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(table)


def _overlaps(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, na, b, nb) those of the asked similarity: partial overlaps of each fragment, summed per pair."""
    left = sets.select(F.col("cid").alias("a"), "frag", F.col("grams").alias("ga"))
    right = sets.select(F.col("cid").alias("b"), "frag", F.col("grams").alias("gb"))
    met = pairs.join(left, "a").join(right, ["b", "frag"])
    partial = met.select("a", "na", "b", "nb", F.size(F.array_intersect("ga", "gb")).alias("common"))
    total = partial.groupBy("a", "na", "b", "nb").agg(F.sum("common").alias("common"))
    return total.filter(F.col("common") * den >= (F.col("na") + F.col("nb") - F.col("common")) * num).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _roots(linked: np.ndarray) -> np.ndarray:
    """Of each row of a matrix of links the least row that it reaches."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root[None], len(linked)).min(axis=1, initial=len(linked)))
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def _forest(num: int, den: int):
    """A spanning forest (src, dst) of the links between different components among the sets of one task."""

    def run(t: pa.Table) -> pa.Table:
        cids, first, which = np.unique(np.array(t.column("cid")), return_index=True, return_inverse=True)
        size, label = np.array(t.column("n"))[first], np.array(t.column("label"))[first]
        common = np.zeros((len(cids), len(cids)), np.float32)
        frag, grams = np.array(t.column("frag")), t.column("grams")
        for f in range(FRAGMENTS):
            rows = np.flatnonzero(frag == f)
            part = grams.take(pa.array(rows)).combine_chunks()
            values = np.asarray(part.flatten())
            owner = np.repeat(which[rows], np.asarray(part.value_lengths()))
            _, column, times = np.unique(values, return_inverse=True, return_counts=True)
            shared = np.flatnonzero(times > 1)  # the others are in no overlap
            place = np.full(len(times), -1)
            place[shared] = np.arange(len(shared))
            column = place[column]
            for lo in range(0, len(shared), COLUMNS):
                use = (column >= lo) & (column < lo + COLUMNS)
                m = np.zeros((len(cids), min(COLUMNS, len(shared) - lo)), np.float32)
                m[owner[use], column[use] - lo] = 1
                common += m @ m.T  # counts below 2**24 are exact
        both = size[:, None] + size[None] - common
        linked = (common * den >= both * num) & (label[:, None] != label[None])
        root = _roots(linked)
        far = np.flatnonzero(root != np.arange(len(cids)))
        return pa.table({"src": pa.array(cids[root[far]], pa.int64()), "dst": pa.array(cids[far], pa.int64())})

    return run


def _differ(a: str, b: str) -> Column:
    """In how many bits two marks differ; the longer one, of at most twice the bits, is folded."""

    def folded(x: Column, other: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(other), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))).otherwise(x)

    x, y = F.col(a), F.col(b)
    return F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, v: t + v)


def _near(pairs: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, na, b, nb) whose marks allow the asked similarity, as (src, dst)."""
    met = pairs.join(marks.select(F.col("cid").alias("a"), F.col("mark").alias("ma")), "a").join(marks.select(F.col("cid").alias("b"), F.col("mark").alias("mb")), "b")
    return met.filter(_differ("ma", "mb") * (den + num) <= (F.col("na") + F.col("nb")) * (den - num)).select(F.col("a").alias("src"), F.col("b").alias("dst"))


class _Bucket:
    """Rows of whole buckets in order of key, task and size: finds those of different groups whose marks are near."""

    def __init__(self, t: pa.Table, num: int, den: int):
        self.num, self.den = num, den
        self.cid, self.n, self.label = (np.asarray(t.column(c).combine_chunks()) for c in ("cid", "n", "label"))
        mark = t.column("mark").combine_chunks()
        self.words = np.asarray(mark.value_lengths()).astype(np.int64)
        self.flat = np.asarray(mark.flatten()).view(np.uint64)
        self.at = np.cumsum(self.words) - self.words
        task = t.column("task").combine_chunks()
        ids = [np.asarray(t.column("key").combine_chunks()), np.asarray(task)]
        self.group = np.cumsum(np.concatenate([[0], np.any([x[1:] != x[:-1] for x in ids], axis=0)])) if len(self.cid) else np.zeros(0, np.int64)

    def _table(self, rows: np.ndarray, words: int) -> np.ndarray:
        """Marks of rows with so many words, or twice as many."""
        place = self.at[rows][:, None] + np.arange(words)
        out = self.flat[place]
        twice = self.words[rows] == 2 * words
        out[twice] ^= self.flat[place[twice] + words]
        return out

    def _allowed(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        return (self.label[i] != self.label[j]) & (low * self.den >= high * self.num)

    def one_by_one(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Near pairs among rows of small groups."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        step, group = 1, self.group[rows]
        while True:
            near = np.flatnonzero(group[:-step] == group[step:])
            if not len(near):
                break
            i, j = rows[near], rows[near + step]
            use = self._allowed(i, j)
            i, j = i[use], j[use]
            least = np.minimum(self.words[i], self.words[j])
            for words in np.unique(least).tolist():
                own = np.flatnonzero(least == words)
                for lo in range(0, len(own), max(1, (1 << 20) // words)):
                    part = own[lo : lo + max(1, (1 << 20) // words)]
                    a, b = i[part], j[part]
                    differ = np.bitwise_count(self._table(a, words) ^ self._table(b, words)).sum(axis=1, dtype=np.int64)
                    keep = differ * (self.den + self.num) <= (self.n[a] + self.n[b]) * (self.den - self.num)
                    out.append((a[keep], b[keep]))
            step += 1
        return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), ())))

    def crowded(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the near pairs of one group."""
        linked = np.zeros((len(rows), len(rows)), bool)
        for words in np.unique(self.words[rows]).tolist():
            one = np.flatnonzero(self.words[rows] == words)
            two = np.flatnonzero((self.words[rows] == words) | (self.words[rows] == 2 * words))
            x, y = self._table(rows[one], words), self._table(rows[two], words)
            differ = np.zeros((len(one), len(two)), np.int64)
            for w in range(words):
                differ += np.bitwise_count(x[:, w][:, None] ^ y[:, w][None])
            i, j = rows[one][:, None], rows[two][None]
            found = self._allowed(i, j) & (differ * (self.den + self.num) <= (self.n[i] + self.n[j]) * (self.den - self.num))
            linked[np.ix_(one, two)] |= found
            linked[np.ix_(two, one)] |= found.T
        root = _roots(linked)
        far = np.flatnonzero(root != np.arange(len(root)))
        return rows[root[far]], rows[far]

    def near(self) -> pa.RecordBatch:
        sizes = np.bincount(self.group) if len(self.group) else np.zeros(0, np.int64)
        rows = np.arange(len(self.cid))
        found = [self.one_by_one(rows[sizes[self.group] <= FEW])] if len(rows) else []
        found += [self.crowded(rows[self.group == g]) for g in np.flatnonzero(sizes > FEW)]
        src, dst = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(self.cid[src], pa.int64()), pa.array(self.cid[dst], pa.int64())], names=["src", "dst"])


def _searched(num: int, den: int):
    """Near pairs of a partition's buckets, which come in order; no more rows are held than a batch and a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, task = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            last = int(np.flatnonzero((key == key[-1]) & (task == task[-1]))[0])  # rows of the last bucket may go on
            if held:
                first = held[0].slice(0, 1)
                if last == 0 and first.column(0)[0].as_py() == key[-1] and first.column(1)[0].as_py() == task[-1]:
                    held.append(pa.Table.from_batches([batch]))
                    continue
            done = pa.concat_tables([*held, pa.Table.from_batches([batch.slice(0, last)])])
            held = [pa.Table.from_batches([batch.slice(last)])]
            if done.num_rows:
                yield _Bucket(done, num, den).near()
        if held:
            yield _Bucket(pa.concat_tables(held), num, den).near()

    return run


def _clusters(rows: DataFrame, marks: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(cid, cluster) of all classes that may link with another by their marks; rows: key, cid, n, rep, rep_n, times."""
    within = F.least("n", "rep_n") * den >= F.greatest("n", "rep_n") * num
    near = scratch.cut(_near(_stars(rows.filter(within)), marks, num, den), "near")
    labels = connected_components(near).select(F.col("id").alias("cid"), "label")
    named = scratch.cut(rows.join(labels, "cid", "left").select("key", "cid", "n", "rows", F.coalesce("label", "cid").alias("label")), "buckets")
    mixed = named.groupBy(F.col("key").alias("k")).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("k")
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    # a task for each two blocks; its number tells both
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j).cast("long") * F.col("blocks") + F.greatest(own, j))
    # of a bucket that is one block only members with another of similar size: the next smaller or larger one is, if any is
    line = Window.partitionBy("key").orderBy("n")
    sized = named.join(mixed, F.col("key") == F.col("k")).withColumn("blocks", blocks)
    alone = sized.filter("blocks = 1").withColumns({"less": F.lag("n").over(line), "more": F.lead("n").over(line)})
    alone = alone.filter((F.col("less") * den >= F.col("n") * num) | (F.col("n") * den >= F.col("more") * num)).drop("less", "more")
    met = alone.union(sized.filter("blocks > 1")).select("key", "cid", "n", "label", F.explode(tasks).alias("task"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = met.join(marks.select("cid", "mark"), "cid").select("key", "task", "cid", "n", "label", "mark").repartition(n, "key", "task").sortWithinPartitions("key", "task", "n")
    more = found.mapInArrow(_searched(num, den), "src long, dst long")
    near = scratch.cut(near.union(more).distinct(), "near")
    return connected_components(near).select(F.col("id").alias("cid"), F.col("label").alias("cluster"))


def _stars(rows: DataFrame) -> DataFrame:
    """One pair (a, na, b, nb) a class: with that of its buckets' least classes which it meets most often."""
    met = rows.filter(F.col("cid") != F.col("rep")).groupBy("cid", "n", "rep", "rep_n").agg(F.count(F.lit(1)).alias("times"))
    best = met.groupBy("cid", "n").agg(F.max_by(F.struct("rep", "rep_n"), F.struct("times", -F.col("rep"))).alias("best"))
    return best.select(F.col("best.rep").alias("a"), F.col("best.rep_n").alias("na"), F.col("cid").alias("b"), F.col("n").alias("nb"))


def _rest(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between classes (cid, n, label, cluster) of one cluster and different labels."""
    sides = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("grams"))
    blocks = lambda c, g: F.ceil(F.greatest(c / BLOCK, g / WEIGHT)).cast("int")
    top = sides.groupBy("cluster").agg(
        F.max(F.struct("sets", "label", "grams")).alias("top"), F.sum("sets").alias("sets"), F.sum("grams").alias("grams")
    ).select("cluster", F.col("top.label").alias("top"), blocks(F.col("sets"), F.col("grams")).alias("all"), blocks(F.col("top.sets"), F.col("top.grams")).alias("inner"), blocks(F.col("sets") - F.col("top.sets"), F.col("grams") - F.col("top.grams")).alias("outer"))
    placed = members.join(top, "cluster").withColumn("block", F.pmod(F.xxhash64("cid"), F.when(F.col("label") == F.col("top"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    task = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tasks = (
        F.when(F.col("all") == 1, F.array(task(0, F.lit(0), F.lit(0))))
        .when(F.col("label") == F.col("top"), F.transform(upto("outer"), lambda j: task(1, F.col("block"), j)))
        .otherwise(F.concat(F.transform(upto("inner"), lambda i: task(1, i, F.col("block"))), F.transform(upto("outer"), lambda j: task(2, F.least("block", j), F.greatest("block", j)))))
    )
    held = placed.select("cid", "n", "label", "cluster", F.explode(tasks).alias("task")).join(sets, "cid")
    return held.groupBy("cluster", "task").applyInArrow(_forest(num, den), "src long, dst long")


def components(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Scratch]:
    """One row per row of ``df``: doc_id, text_hash (xxhash64), n (size of its set), label (of its component; null for the
    empty set); and the folder that holds these rows."""
    if not den < 2 * num <= 2 * den:
        raise ValueError("similarities above a half and up to one")
    spark = df.sparkSession
    scratch, kept = Scratch(spark, "fragment-join"), Scratch(spark, "members")
    texts = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    survey = scratch.cut(texts.mapInArrow(_survey(n), "doc_id long, text_hash long, n long, cid long, chunk int, counts binary"), "survey")
    order = _order(spark, survey)
    index = scratch.cut(texts.select("text").mapInArrow(_index(n, num, den, order), "key long, cid long, n long, mark array<long>"), "index")
    keys = index.filter("key IS NOT NULL").select("key", "cid", "n")
    least = keys.groupBy("key").agg(F.min("cid").alias("rep"), F.max("cid").alias("last"), F.count(F.lit(1)).alias("rows"))
    shared = scratch.cut(least.filter("rep <> last").select("key", "rep", "rows"), "keys")
    rows = keys.mapInArrow(_where_marked(_bits(spark, shared.select("key"))), "key long, cid long, n long").distinct().join(shared, "key")
    rows = scratch.cut(rows, "buckets")
    reps = rows.filter("cid = rep").select("rep", F.col("n").alias("rep_n")).distinct()
    rows = rows.join(reps, "rep")
    known = index.filter("key IS NULL").select("cid", "n", "mark").dropDuplicates(["cid"])
    near = known.mapInArrow(_where_marked(_bits(spark, rows.select("cid"))), "cid long, n long, mark array<long>")
    near = scratch.cut(near, "marks")
    clusters = scratch.cut(_clusters(rows, near, num, den, scratch).join(near.select("cid", "n"), "cid"), "clusters")
    sets = texts.select("text").mapInArrow(_needed(n, _bits(spark, clusters.select("cid")), order), "cid long, frag int, grams array<long>")
    sets = scratch.cut(sets.dropDuplicates(["cid", "frag"]), "sets")
    scratch.drop(index, shared)
    own = rows.join(clusters.select("cid", "cluster"), "cid").join(clusters.select(F.col("cid").alias("rep"), F.col("cluster").alias("rep_cluster")), "rep").filter("cluster = rep_cluster")
    links = scratch.cut(_overlaps(_stars(own), sets, num, den), "links")
    labels = connected_components(links).select(F.col("id").alias("cid"), "label")
    members = scratch.cut(clusters.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid")), "members")
    mixed = members.groupBy(F.col("cluster").alias("c")).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("c")
    members = members.join(mixed, F.col("cluster") == F.col("c")).drop("c")
    links = scratch.cut(links.union(_rest(members, sets, num, den)), "links")
    labels = connected_components(links).select(F.col("id").alias("cid"), "label")
    docs = survey.filter("chunk IS NULL").join(labels, "cid", "left")
    docs = kept.cut(docs.select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.coalesce("label", "cid")).alias("label")), "members")
    scratch.drop()
    return docs, kept


def near_duplicates(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles (size of its set of distinct n-word shingles of the text with A-Z
    lower-cased), component_id (smallest doc_id that links reach, itself included).

    Two documents link when den * |A and B| >= num * |A or B|. Null, empty and wordless texts have the empty set and
    link with nothing; a text of fewer words than n has one shingle of all of them. Repeated rows and keys are rows like
    others; a null key is no candidate for the smallest. Other columns are dropped; the empty table gives no rows.
    """
    docs, _ = components(df, n, num, den, key, text)
    least = docs.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return docs.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def without_duplicates(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the one of the smallest key (nulls last; of equal
    keys that of the smallest hash of its text). Rows that are equal in key and text are one document, of which any row
    stays. Texts without words link with nothing. All columns stay."""
    docs, _ = components(df, n, num, den, key, text)
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = docs.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min(one).alias("first"))
    gone = docs.join(first, "label").filter(one != F.col("first")).select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    again = docs.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    named = lambda k, h: F.xxhash64(k, h).alias("id")
    table = _bits(df.sparkSession, gone.select(named("_gone_id", "_gone_hash")).union(again.select(named("doc_id", "text_hash"))))

    @F.arrow_udf("boolean")
    def marked(ids: pa.Array) -> pa.Array:
        return pa.array(_marked(table.value, np.asarray(ids)))

    # only rows that may go, or may be there more than once, are moved; the others stay where they are
    rows = df.withColumn("_may_go", marked(named(F.col(key).cast("bigint"), F.xxhash64(text))))
    own = Window.partitionBy(F.col(key).cast("bigint"), F.xxhash64(text)).orderBy(F.lit(0))
    some = rows.filter("_may_go").withColumn("_rank_of_copy", F.row_number().over(own)).filter("_rank_of_copy = 1").drop("_rank_of_copy", "_may_go")
    same = F.col(key).cast("bigint").eqNullSafe(F.col("_gone_id")) & (F.xxhash64(text) == F.col("_gone_hash"))
    return rows.filter("NOT _may_go").drop("_may_go").unionByName(some.join(gone, same, "left_anti"))
