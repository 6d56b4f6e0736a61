from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from nearlabel.llm import queries
from nearlabel.llm import rolling_median as q

SCHEMA = "click_id long, kind string, ts timestamp_ntz, value double, n int, own string"
START = datetime(2024, 3, 31, 0, 30)


def middle2(xs):
    xs = sorted(xs)
    return xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]


def brute(rows, minutes=15):
    once = {}
    for i, kind, ts, value, *_ in rows:
        if ts is not None:
            c = None if value is None or not np.isfinite(value) or abs(100 * value + 0.5) >= q.LARGEST else int(np.floor(100 * value + 0.5))
            once[i if i is not None else (ts, kind, c)] = (i, kind, ts, c)
    out = []
    for i, kind, ts, c in once.values():
        w = [d for _, k, t, d in once.values() if k == kind and d is not None and ts - timedelta(minutes=minutes) < t <= ts]
        if not w:
            out.append((i, kind, 0, None, None, None))
            continue
        m2 = middle2(w)
        m4 = middle2([abs(2 * d - m2) for d in w])
        out.append((i, kind, len(w), m2, m4, None if c is None else 2 * abs(2 * c - m2) > 2 * m4))
    return sorted(out, key=str)


def made(seed, n, minutes, ticks):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        value = [None, float("nan"), float("inf"), -1e300, 0.0][rng.integers(5)] if rng.random() < 0.1 else round(float(rng.choice([rng.normal(20, 5), rng.exponential(400), -3.005, 7.0])), 3)
        rows.append((i, [None, "a", "b"][rng.integers(3)], None if rng.random() < 0.02 else START + timedelta(minutes=minutes) * (int(rng.integers(ticks)) / ticks), value, 1, "x"))
    return rows


@pytest.mark.parametrize(("seed", "n", "minutes", "ticks"), [(1, 400, 90, 10_000), (2, 300, 15, 12), (3, 200, 3000, 200), (4, 300, 60, 4)])
def test_brute_force(spark, monkeypatch, seed, n, minutes, ticks):
    """Sparse and dense series, many rows at one time, times exactly a window apart, repeated rows and odd values."""
    monkeypatch.setattr(q, "CHUNK", 64)
    rows = made(seed, n, minutes, ticks)
    df = spark.createDataFrame(rows + rows[:50], SCHEMA)
    assert sorted(map(tuple, q.rolling(df).collect()), key=str) == brute(rows)


def test_no_ids_and_differing_repeats(spark):
    """Equal rows without id are one click each; of rows that share an id the earliest one counts."""
    rows = [(None, "a", START, 1.0), (None, "a", START, 1.0), (None, "a", START, 2.0), (None, None, None, 2.0), (7, "a", START, 5.0), (7, "a", START + timedelta(minutes=1), 9.0)]
    df = spark.createDataFrame(rows, "click_id long, kind string, ts timestamp_ntz, value double")
    assert sorted(map(tuple, q.rolling(df).collect()), key=str) == brute(rows[:5])
    assert q.rolling(df.limit(0)).count() == 0 and q.rolling(df.filter("ts IS NULL")).count() == 0


def test_zone_does_not_matter(spark):
    """An hour that a zone skips is an hour like others."""
    rows = made(5, 150, 180, 900)
    df = spark.createDataFrame(rows, SCHEMA)
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert sorted(map(tuple, q.rolling(df).collect()), key=str) == brute(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_slots_across_batches(monkeypatch):
    """Slots that end inside batches, one longer than a chunk, rows of several at once."""
    rng = np.random.default_rng(8)
    sizes = [3, 700, 1, 40, 40, 200, 5]
    parts = [pa.RecordBatch.from_pydict({"id": np.arange(n), "series": pa.array([None if k % 3 == 0 else "s"] * n, pa.string()), "slot": np.full(n, k), "at": np.sort(rng.integers(0, 2000, n)), "own": np.ones(n, bool), "value": pa.array(rng.integers(0, 50, n), mask=rng.random(n) < 0.2)}) for k, n in enumerate(sizes)]
    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    run = q._solve(pa.int64(), pa.string(), 500)
    want = [r for p in parts for b in run(iter([p])) for r in b.to_pylist()]
    for chunk, step in ((8, 17), (16384, 90), (50, 1)):
        monkeypatch.setattr(q, "CHUNK", chunk)
        monkeypatch.setattr(q, "ASKED", 64)
        assert [r for b in run(whole.slice(i, step) for i in range(0, whole.num_rows, step)) for r in b.to_pylist()] == want


def test_wavelet_matrix():
    rng = np.random.default_rng(9)
    for size in (1, 2, 7, 300):
        ranks = rng.integers(0, size, 500)
        m = q.WaveletMatrix(ranks, size)
        lo = rng.integers(0, 500, 200)
        hi = lo + 1 + rng.integers(0, 500 - lo)
        k, r = rng.integers(0, hi - lo), rng.integers(0, size + 3, 200)
        assert m.quantile(lo, hi, k).tolist() == [sorted(ranks[a:b])[c] for a, b, c in zip(lo, hi, k, strict=True)]
        assert m.less(lo, hi, r).tolist() == [int((ranks[a:b] < c).sum()) for a, b, c in zip(lo, hi, r, strict=True)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW clicks AS SELECT * FROM '{sf}/clicks.parquet'")
    want = con.sql(queries.oracle_sql()["op13_rolling_median"])
    df = queries.op13_rolling_median(spark, sf)
    assert df.columns == want.columns and sorted(map(tuple, df.collect()), key=str) == sorted(want.fetchall(), key=str)
