import duckdb
import numpy as np
import pytest

from nearlabel.llm import queries, voronoi_knn

SCHEMA = "vec_id long, embedding array<float>, score long"


def brute(rows, asked, k):
    v = {i: np.array([int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e, _ in rows if e and all(x is not None and np.isfinite(x) for x in e)}
    out = set()
    for q in asked:
        if q in v:
            best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:k]
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    return out


def test_equals_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = set(duckdb.sql(voronoi_knn.ORACLE).fetchall())
    assert {tuple(r) for r in queries.op10_voronoi_knn(spark, sf).collect()} == want and want


@pytest.mark.parametrize("block", [7, 8192])
def test_clusters_ties_and_odd_rows(spark, block, monkeypatch):
    monkeypatch.setattr(voronoi_knn, "BLOCK", block)
    monkeypatch.setattr(voronoi_knn, "QUERIES", 9)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 5))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=5) * 0.05], 0) for i in range(200)]
    rows += [(i, rows[0][1], 0) for i in range(200, 260)]
    rows += [(300, None, 0), (301, [1.0, None, 0.0, 0.0, 0.0], 0), (302, [float("inf"), 0.0, 0.0, 0.0, 0.0], 0), (303, [float("nan")] * 5, 0), (304, [0.0] * 5, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    ids = [*range(0, 260, 10), 300, 304]
    got = voronoi_knn.knn_join(df, df.filter(df.vec_id.isin(ids)), k=4).collect()
    assert {tuple(r) for r in got} == brute(rows, ids, 4) and len(got) == 4 * (len(ids) - 1)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [0.5, 1.0], 0)], SCHEMA)
    assert {tuple(r) for r in voronoi_knn.knn_join(df, df).collect()} == brute([(0, [1.0, 2.0], 0), (1, [0.5, 1.0], 0)], [0, 1], 5)
    assert voronoi_knn.knn_join(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [7, 8192])
def test_repeated_query_rows(spark, block, monkeypatch):
    """Rows with the query's own id take no place of a neighbour, however many there are."""
    monkeypatch.setattr(voronoi_knn, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5)], 0) for i in range(120)]
    df = spark.createDataFrame(rows + [(0, rows[0][1], 0)] * 40 + [(5, rows[5][1], 0)] * 3, SCHEMA)
    got = voronoi_knn.knn_join(df, df.filter("vec_id in (0, 7)"), k=4).collect()
    v = {i: np.floor(256 * np.array(e, np.float32).astype(float)).astype(int) for i, e, _ in rows}
    want = set()
    for q in (0, 7):
        near = sorted((-int(v[q] @ v[c]), c) for c, times in [(i, 41 if i == 0 else 4 if i == 5 else 1) for i in v] for _ in range(times) if c != q)[:4]
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(near)}
    assert {tuple(r) for r in got} == want and len(got) == 8


def test_slices_and_pruning(spark, monkeypatch):
    """Clustered vectors: queries seek few cells, blocks that none seeks are not moved, slices get what they seek alone."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(10, 8)) * 5
    rows = [(i, [float(np.float32(x)) for x in centres[i % 10] + rng.normal(size=8) * 0.02], 0) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    ids = [*range(0, 4000, 40), *range(1, 4000, 40)]
    asked = df.filter(df.vec_id.isin(ids))
    found = []
    for queries in (voronoi_knn.QUERIES, 60):
        monkeypatch.setattr(voronoi_knn, "QUERIES", queries)
        sought, placed = voronoi_knn._plan(df, asked, 5, "vec_id", "embedding", 256, None)
        found.append(sought.select("slice").distinct().count())
        cells, blocks = sought.select("id", "cell").distinct().count(), placed.count()
        assert cells < 0.3 * len(ids) * min(voronoi_knn.PIVOTS, int(4000**0.5) // 2) and blocks < 0.5 * 4000
        assert {tuple(r) for r in voronoi_knn.knn_join(df, asked, k=5).collect()} == brute(rows, ids, 5)
    assert found[0] == 1 and found[1] >= 4


def test_unequal_lengths_and_far_components(spark):
    """Lengths that would reshape across rows, components beyond what fits: such rows neither answer nor ask."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)], 0) for i in range(40)]
    odd = [(100, [1.0] * 3, 0), (101, [1.0] * 9, 0), (102, [1.0] * 12, 0), (103, [1e30] * 6, 0), (104, [-1e15] + [0.0] * 5, 0), (105, [], 0)]
    df = spark.createDataFrame(rows[:20] + odd + rows[20:], SCHEMA)
    ids = [0, 7, 100, 102, 103, 105]
    got = {tuple(r) for r in voronoi_knn.knn_join(df, df.filter(df.vec_id.isin(ids)), k=4).collect()}
    assert got == brute(rows, [0, 7], 4)
    far = [*rows, (200, [30_000.0] * 6, 0), (201, [-60_000.0, 5.0, 1.0, 0.0, 2.0, 9.0], 0)]
    got = {tuple(r) for r in voronoi_knn.knn_join(spark.createDataFrame(far, SCHEMA), spark.createDataFrame([far[0], far[-1]], SCHEMA), k=4).collect()}
    assert got == brute(far, [0, 201], 4)
    assert voronoi_knn.knn_join(df.filter("vec_id >= 103"), df).count() == 0
