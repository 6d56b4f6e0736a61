"""Exact rolling medians and median absolute deviations of series in time.

A series is cut into slots of time. A row goes to its own slot and, if a later slot's windows can reach it, to the next
one as halo, so each slot can be answered alone; Spark deals slots out by hash and sorts them by time. How many windows
a slot spans follows from the densest stretch of one window's length, the one number that is asked first: a slot with
its halo holds about CHUNK rows at most, or the rows of two windows where these are more. Neither depends on the number
of rows in a series, and no series meets in one task.

A task reads its slots as a stream and answers runs of whole slots of about CHUNK rows with one wavelet matrix over the
values' ranks in order of time: a window is a range of positions, quantiles of all windows come from one descent of the
levels, and the deviation's radius is bisected for all windows at once by counting the values in a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that meet in one matrix, and that a slot aims at; most windows that a slot spans.
CHUNK, SPANS = 16384, 96
#: Rows whose windows are asked together.
ASKED = 65536
#: Values beyond this size in cents count as none: eight times a value must fit 64 bits.
LARGEST = 1 << 58


def cents(value: Column) -> Column:
    """floor(100 * value + 0.5); null for null, non-finite and too large values."""
    x = F.lit(100.0) * value.cast("double") + F.lit(0.5)
    return F.when(F.abs(x) < F.lit(float(LARGEST)), F.floor(x).cast("bigint"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time's own digits, whatever the session's zone."""
    parts = F.unix_date(F.to_date(ts)).cast("bigint") * 24 + F.hour(ts)
    seconds = F.extract(F.lit("SECOND"), ts) * F.lit(1_000_000)
    return (parts * 60 + F.minute(ts)) * 60_000_000 + seconds.cast("bigint")


class WaveletMatrix:
    """Ranks in order of position. For every bit, from the highest: how many zeros lie before each position."""

    def __init__(self, ranks: np.ndarray, size: int):
        self.levels: list[tuple[int, np.ndarray]] = []
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            zero = (ranks >> bit) & 1 == 0
            before = np.zeros(len(ranks) + 1, np.int32)
            np.cumsum(zero, out=before[1:])
            self.levels.append((bit, before))
            ranks = np.concatenate([ranks[zero], ranks[~zero]])

    def quantile(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest rank, from 0, at positions lo to hi, for 0 <= k < hi - lo."""
        out = np.zeros(len(k), np.int64)
        for bit, before in self.levels:
            a, b = before[lo], before[hi]
            zeros = b - a
            one = k >= zeros
            k = np.where(one, k - zeros, k)
            lo, hi = np.where(one, before[-1] + lo - a, a), np.where(one, before[-1] + hi - b, b)
            out |= one.astype(np.int64) << bit
        return out

    def less(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many ranks below ``rank`` lie at positions lo to hi."""
        top = 1 << len(self.levels)
        out, rank, above = np.zeros(len(rank), np.int64), np.minimum(rank, top - 1), rank >= top
        whole = hi - lo
        for bit, before in self.levels:
            a, b = before[lo], before[hi]
            one = (rank >> bit) & 1 == 1
            out += np.where(one, b - a, 0)
            lo, hi = np.where(one, before[-1] + lo - a, a), np.where(one, before[-1] + hi - b, b)
        return np.where(above, whole, out)


class Windows:
    """Medians and deviations over ranges of positions in a sequence of values."""

    def __init__(self, values: np.ndarray):
        self.values, ranks = np.unique(values, return_inverse=True)
        self.matrix = WaveletMatrix(ranks.astype(np.int64), len(self.values))

    def at(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        return self.values[self.matrix.quantile(lo, hi, k)]

    def around(self, lo: np.ndarray, hi: np.ndarray, m2: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values c of a range lie below |2c - m2| <= r, and how many do not lie above it."""
        below = self.matrix.less(lo, hi, np.searchsorted(self.values, -((r - m2) // 2), "left"))
        return below, self.matrix.less(lo, hi, np.searchsorted(self.values, (m2 + r) // 2, "right"))

    def median2(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        n = hi - lo
        return self.at(lo, hi, (n - 1) // 2) + self.at(lo, hi, n // 2)

    def mad4(self, lo: np.ndarray, hi: np.ndarray, m2: np.ndarray) -> np.ndarray:
        """The doubled median of |2c - m2|: its lower middle by bisecting the radius, the upper one is that or the next."""
        n = hi - lo
        k = (n - 1) // 2
        # k + 1 values around the median lie between two quantiles, so the nearer of these is too small and the farther enough
        right = np.minimum(n - 1, k + (k + 1) // 2)
        low, high = m2 - 2 * self.at(lo, hi, right - k), 2 * self.at(lo, hi, right) - m2
        least, most = np.maximum(np.minimum(low, high), 0), np.maximum(low, high)
        open_ = np.nonzero(least < most)[0]
        while len(open_):
            r = least[open_] + (most[open_] - least[open_]) // 2
            below, upto = self.around(lo[open_], hi[open_], m2[open_], r)
            enough = upto - below > k[open_]
            most[open_], least[open_] = np.where(enough, r, most[open_]), np.where(enough, least[open_], r + 1)
            open_ = open_[least[open_] < most[open_]]
        below, upto = self.around(lo, hi, m2, most)
        second, far = most.copy(), np.iinfo(np.int64).max
        more = np.nonzero(upto - below <= n // 2)[0]
        if len(more):
            lo, hi, m2, below, upto, n = (x[more] for x in (lo, hi, m2, below, upto, n))
            left = np.where(below > 0, m2 - 2 * self.at(lo, hi, np.maximum(below - 1, 0)), far)
            right = np.where(upto < n, 2 * self.at(lo, hi, np.minimum(upto, n - 1)) - m2, far)
            second[more] = np.minimum(left, right)
        return most + second


def answer(slot: np.ndarray, at: np.ndarray, value: np.ndarray, has: np.ndarray, own: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """For the rows ``own`` (numbers of rows): n, median2, mad4, far, and whether median2 and far are known.

    Rows lie in order of slot and ``at``, the microseconds since the slot's halo began; the first ``window`` are halo.
    """
    stride = int(at.max(initial=0)) + window + 1
    key = slot * stride + at
    position = np.concatenate([[0], np.cumsum(has)])
    n, median2, mad4 = (np.zeros(len(own), np.int64) for _ in range(3))
    windows = Windows(value[has]) if has.any() else None
    for a in range(0, len(own), ASKED):
        mine = own[a : a + ASKED]
        lo, hi = position[np.searchsorted(key, key[mine] - window, "right")], position[np.searchsorted(key, key[mine], "right")]
        n[a : a + ASKED] = hi - lo
        full = np.nonzero(hi > lo)[0]
        if len(full):
            # rows of one time share a window
            both, inverse = np.unique(lo[full] * (len(key) + 1) + hi[full], return_inverse=True)
            lo, hi = both // (len(key) + 1), both % (len(key) + 1)
            m2 = windows.median2(lo, hi)
            median2[a + full], mad4[a + full] = m2[inverse], windows.mad4(lo, hi, m2)[inverse]
    far = 2 * np.abs(2 * value[own] - median2) > 2 * mad4
    return n, median2, mad4, far, n > 0, (n > 0) & has[own]


def _solve(key_type: pa.DataType, series_type: pa.DataType, window: int):
    schema = pa.schema([("id", key_type), ("series", series_type), ("n", pa.int64()), ("median2", pa.int64()), ("mad4", pa.int64()), ("far", pa.bool_())])

    def starts(rows: pa.Table) -> np.ndarray:
        """Where a new slot begins."""
        series = pc.dictionary_encode(rows.column("series").combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        slot = rows.column("slot").to_numpy()
        return np.concatenate([[True], (series[1:] != series[:-1]) | (slot[1:] != slot[:-1])])

    def solved(rows: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        has = rows.column("value").is_valid().to_numpy()
        own = np.nonzero(rows.column("own").to_numpy())[0]
        value = pc.fill_null(rows.column("value"), 0).to_numpy()
        n, median2, mad4, far, known, judged = answer(np.cumsum(new) - 1, rows.column("at").to_numpy(), value, has, own, window)
        kept = rows.select(["id", "series"]).take(pa.array(own)).combine_chunks()
        ids, series = (c.combine_chunks() for c in kept.columns)
        return pa.RecordBatch.from_arrays([ids, series, pa.array(n), pa.array(median2, mask=~known), pa.array(mad4, mask=~known), pa.array(far, mask=~judged)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count < 2 * CHUNK:
                continue
            rows = pa.Table.from_batches(held)
            new = starts(rows)
            edge = int(np.nonzero(new)[0][-1])
            if edge == 0:  # one slot so far; the batches stay apart, so that a long slot is joined seldom
                held, count = rows.to_batches(), 0
                continue
            yield solved(rows.slice(0, edge), new[:edge])
            held = rows.slice(edge).combine_chunks().to_batches()
            count = rows.num_rows - edge
        if held:
            rows = pa.Table.from_batches(held)
            yield solved(rows, starts(rows))

    return run


def once(clicks: DataFrame, key: str = "click_id") -> DataFrame:
    """Each id once: of repeated rows that differ the least one by time, series and value. Rows without an id are one
    click if they are equal, so that they never meet in one task."""
    same = F.when(F.col(key).isNull(), F.xxhash64("us", "series", "value"))
    w = Window.partitionBy(key, same).orderBy("us", "series", "value")
    return clicks.withColumn("row", F.row_number().over(w)).filter("row = 1").drop("row")


def rolling(df: DataFrame, minutes: int = 15, key: str = "click_id", series: str = "kind", ts: str = "ts", value: str = "value") -> DataFrame:
    """key, series, n, median2, mad4, far of every id once, over the values of its series in the ``minutes`` that end
    with its own time, rows at its own time included.

    Rows without time are dropped; a null series is a series; rows without a value (null, not finite, or of LARGEST cents
    and more) get the window of others. Where a window has no value n is 0 and the rest null; far is null without an own
    value. Other columns are dropped, whatever their names. An empty frame gives no rows. A task's memory follows from
    CHUNK and, where that is more, from the rows of two windows of a series.
    """
    window = minutes * 60_000_000
    rows = df.filter(F.col(ts).isNotNull()).select(F.col(key).alias("id"), F.col(series).alias("series"), micros(F.col(ts)).alias("us"), cents(F.col(value)).alias("value"))
    dense = rows.groupBy("series", F.floor(F.col("us") / F.lit(window)).alias("stretch")).count().agg(F.max("count").alias("n")).first().n
    span = window * int(np.clip(CHUNK // (dense or 1), 1, SPANS))
    slot = F.floor((F.col("us") - F.pmod(F.col("us"), F.lit(span))) / F.lit(span)).cast("bigint")
    # a row within one window before the end of its slot is halo of the next one
    reached = F.when(F.pmod(F.col("us"), F.lit(span)) >= span - window, F.array(slot, slot + 1)).otherwise(F.array(slot))
    dealt = once(rows, "id").select("*", F.posexplode(reached).alias("halo", "slot"))
    dealt = dealt.select("id", "series", "slot", (F.col("us") - F.col("slot") * span + window).alias("at"), (F.col("halo") == 0).alias("own"), "value")
    dealt = dealt.repartition("series", "slot").sortWithinPartitions("series", "slot", "at")
    types = {f.name: f.dataType for f in dealt.schema}
    from pyspark.sql.pandas.types import to_arrow_type

    out = dealt.mapInArrow(_solve(to_arrow_type(types["id"]), to_arrow_type(types["series"]), window), f"id {types['id'].simpleString()}, series {types['series'].simpleString()}, n long, median2 long, mad4 long, far boolean")
    return out.withColumnsRenamed({"id": key, "series": series})


ORACLE = """
WITH c AS (SELECT DISTINCT click_id, kind, epoch_us(ts) AS t, CASE WHEN isfinite(value) THEN CAST(floor(100 * value + 0.5) AS BIGINT) END AS c FROM clicks WHERE ts IS NOT NULL),
p AS (SELECT a.click_id, a.kind, a.c AS own, b.c AS c FROM c a LEFT JOIN c b ON b.kind IS NOT DISTINCT FROM a.kind AND b.t > a.t - 900000000 AND b.t <= a.t AND b.c IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY c) AS k, count(c) OVER (PARTITION BY click_id) AS n FROM p),
m AS (SELECT *, sum(CASE WHEN k = (n + 1) // 2 THEN c ELSE 0 END + CASE WHEN k = n // 2 + 1 THEN c ELSE 0 END) OVER (PARTITION BY click_id) AS m2 FROM r),
d AS (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY abs(2 * c - m2)) AS j FROM m),
s AS (SELECT click_id, any_value(kind) AS kind, any_value(own) AS own, max(n) AS n, max(m2) AS m2,
    sum(CASE WHEN j = (n + 1) // 2 THEN abs(2 * c - m2) ELSE 0 END + CASE WHEN j = n // 2 + 1 THEN abs(2 * c - m2) ELSE 0 END) AS d4 FROM d GROUP BY click_id)
SELECT click_id, kind, CAST(n AS BIGINT) AS n, CASE WHEN n > 0 THEN CAST(m2 AS BIGINT) END AS median2, CASE WHEN n > 0 THEN CAST(d4 AS BIGINT) END AS mad4,
    CASE WHEN n > 0 THEN 2 * abs(2 * own - m2) > 2 * d4 END AS far FROM s
"""
