import hashlib

from pyspark.sql import functions as F

from nearlabel.operators import lsh


def brute(vector, p):
    sign = lambda t, d, b: 1 if hashlib.md5(f"{t}:{d}:{p.seed}".encode()).hexdigest()[b] < "8" else -1
    known = [(d, q) for d, q in vector if q is not None]
    return [tuple(sum(q * sign(t, d, b) for d, q in known) if known else None for b in range(p.bits)) for t in range(p.tables)]


def test_sums_against_brute_force(spark, monkeypatch):
    """Vectors longer than a block, null weights, null ids, weights beyond 2^53, positions whose signs aren't kept."""
    monkeypatch.setattr(lsh, "ROWS", 7)
    p = lsh.Params(tables=5, bits=13)
    vectors = {1: [(d, d * 37 % 101 - 50) for d in range(40)], 2: [(3, None), (4, None)], 3: [(3, None), (1 << 30, 5), (2, -5)], 4: [(8, (1 << 60) + 1), (9, -(1 << 60))], None: [(1, 0)]}
    rows = spark.createDataFrame([(k, d, q) for k, v in vectors.items() for d, q in v], "doc_id long, pos long, q long")
    sums = {(r.doc_id, r.tbl): tuple(r[2:]) for r in lsh.bit_sums(rows, p).collect()}
    assert sums == {(k, t): s for k, v in vectors.items() for t, s in enumerate(brute(v, p))}
    got = {(r.doc_id, r.tbl): r.bucket for r in lsh.signatures(rows, p).collect()}
    assert got == {k: sum(1 << b for b, x in enumerate(s) if x is not None and x >= 0) for k, s in sums.items()}


def test_vectors_alone_are_shuffled(spark):
    """What is moved are vectors; a row a table and vector, 36 times as many, is made where they lie."""
    rows = spark.range(200).selectExpr("id % 20 AS doc_id", "id AS pos", "id AS q")
    plan = lsh.signatures(rows, lsh.Params())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan and not lsh.signatures(rows, lsh.Params()).filter(F.col("bucket").isNull()).count()
