import hashlib
import math

import duckdb
import numpy as np
import pytest

from nearlabel.llm import queries
from nearlabel.llm import vector_codes as q

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def brute(rows, parts, entries, rounds, scale=1024):
    """The whole result with Python's integers."""
    good = [(i, [math.floor(scale * float(np.float32(c))) for c in x], label) for i, x, label, *_ in rows if x and all(c is not None and np.isfinite(c) and abs(c) < (2.0**61 / len(x)) ** 0.5 / scale - 1 for c in x)]
    if not good:
        return []
    least = {}
    for i, x, _ in good:
        if i is not None and (i not in least or x < least[i]):
            least[i] = x
    length = len(least[min(least)])
    good = [g for g in good if len(g[1]) == length]
    least = {i: x for i, x in least.items() if len(x) == length}
    w = length // parts
    cut = lambda x, p: x[p * w : (p + 1) * w]
    book = [[cut(least[i], p) for i in sorted(least)[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, p: min((dist(cut(x, p), e), k) for k, e in enumerate(book[p]))
    for _ in range(rounds):
        at = [[[] for _ in b] for b in book]
        for _, x, _ in good:
            for p in range(parts):
                at[p][near(x, p)[1]].append(cut(x, p))
        book = [[[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for e, m in zip(book[p], at[p], strict=True)] for p in range(parts)]
    sha = hashlib.sha256(",".join(str(c) for b in book for e in b for c in e).encode()).hexdigest()
    found = [(i, [near(x, p) for p in range(parts)], label) for i, x, label in good]
    total = {}
    for _, n, label in found:
        total[label] = total.get(label, 0) + sum(d for d, _ in n)
    return sorted(((i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), total[label], sha) for i, n, label in found), key=str)


def rows_of(seed, n, length, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(c)) for c in rng.normal(size=length) * spread], [None, 1, 2][rng.integers(3)], "x", 3) for i in rng.permutation(n)]


ODD = [(900, None, 1, "x", 1), (901, [], 1, "x", 1), (902, [None] * 8, None, "x", 1), (903, [float("nan")] * 8, 1, "x", 1), (904, [float("inf")] + [0.0] * 7, 1, "x", 1), (905, [1.0] * 4, 1, "x", 1), (906, [1e30] * 8, 1, "x", 1), (907, [90_000.0] * 8, 2, "x", 1), (None, [0.5] * 8, 2, "x", 1)]


@pytest.mark.parametrize("join", [False, True])
def test_brute_force(spark, monkeypatch, join):
    """Fewer rows than entries and more, repeated rows and ids, ties between entries, odd vectors, clashing names."""
    if join:
        monkeypatch.setattr(q, "BROADCAST_LABELS", 0)
    rows = rows_of(1, 60, 8)
    rows += rows[:7] + [(rows[9][0], [0.25] * 8, 1, "x", 1)] + ODD
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for entries in (4, 256):
        got = q.compress(df, entries=entries, rounds=3)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 4, entries, 3)


def test_batches_and_far_values(monkeypatch):
    monkeypatch.setattr(q, "ROWS", 7)
    rng = np.random.default_rng(3)
    x, books = rng.integers(-1 << 28, 1 << 28, (40, 8)), rng.integers(-1 << 28, 1 << 28, (2, 9, 4))
    books[:, 5] = books[:, 2]
    code, error = q.assign(x, books)
    for i in range(40):
        for p in range(2):
            d = [sum((int(a) - int(b)) ** 2 for a, b in zip(x[i, p * 4 : p * 4 + 4], e, strict=True)) for e in books[p]]
            assert (error[i, p], code[i, p]) == (min(d), d.index(min(d)))


def test_none(spark):
    df = spark.createDataFrame(ODD[:5], SCHEMA)
    assert q.compress(df).count() == 0 and q.compress(df.limit(0)).count() == 0
    assert q.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, "x", 1)], SCHEMA)).count() == 0
    alone = q.compress(spark.createDataFrame(ODD[-1:], SCHEMA)).collect()
    assert [(r.vec_id, r.code, r.error) for r in alone] == [(None, "00000000", 0)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op12_vector_codes"])
    df = queries.op12_vector_codes(spark, sf)
    assert df.columns == want.columns and sorted(map(tuple, df.collect()), key=str) == sorted(want.fetchall(), key=str)
