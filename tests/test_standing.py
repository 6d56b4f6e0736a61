import numpy as np
import pandas as pd

from nearlabel.operators import lsh
from nearlabel.session import scratch_dir
from nearlabel.streaming import standing


def brute(held, rows, capacity):
    """Row by row, with a list a bucket."""
    queues, out = {b: list(v) for b, v in held.items()}, []
    for _, i, inserts, asks, b in sorted(rows):
        queue = queues.setdefault(b, [])
        if asks:
            out += [(i, c) for c in queue[-capacity:]]
        if inserts:
            queue.append(i)
    return out, {b: q[-capacity:] for b, q in queues.items() if q}


def test_bounded_queues():
    """Several micro-batches; inserts, requests and rows that are both, in any order of arrival."""
    rng = np.random.default_rng(5)
    held, bucket, ids = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in range(6):
        kind = rng.integers(3, size=120)
        rows = [(k * 1000 + int(s), int(i), bool(a != 1), bool(a != 0), int(b)) for s, i, a, b in zip(rng.permutation(120), rng.permutation(120) + k * 200, kind, rng.integers(0, 7, 120), strict=True)]
        frame = pd.DataFrame(rows, columns=["seq", "id", "inserts", "asks", "bucket"])
        asker, found, bucket, ids = standing.met(bucket, ids, frame, 5)
        want, held = brute(held, rows, 5)
        assert sorted(zip(asker.tolist(), found.tolist(), strict=True)) == sorted(want)
        now = {}
        for b, i in zip(bucket.tolist(), ids.tolist(), strict=True):
            now.setdefault(b, []).append(i)
        assert now == held


def test_service(spark):
    """Requests before and after inserts, a service that starts again, odd vectors, and the state read as a table."""
    p = lsh.Params(tables=3, bits=4, capacity=3, top_candidates=20, top_k=3)
    path = scratch_dir(spark, "standing")
    rng = np.random.default_rng(2)
    vectors = {i: {int(d): float(w) for d, w in zip(rng.permutation(8)[:4], rng.random(4), strict=True)} for i in range(12)}
    frame = lambda ids: spark.createDataFrame([(i, d, w) for i in ids for d, w in vectors[i].items()], "doc_id long, pos long, w double")
    index = standing.Standing(spark, path, p)
    index.insert(frame(range(6)), lsh.F.col("doc_id"))
    index.advance()
    again = standing.Standing(spark, path, p)  # another driver
    again.ask(frame([8, 9]), lsh.F.lit(50))
    again.insert(frame([8]), lsh.F.lit(60))
    again.advance()
    sigs = {}
    for r in lsh.signatures(frame(range(12)).selectExpr("doc_id", "pos", "cast(round(w * 1000000) as bigint) AS q"), p).collect():
        sigs[r.doc_id, r.tbl] = r.bucket
    want = []
    for q in (8, 9):
        n = {}
        for t in range(p.tables):
            for c in [i for i in range(6) if sigs[i, t] == sigs[q, t]][-p.capacity :]:
                n[c] = n.get(c, 0) + 1
        pairs = {c: standing.cosine(*(np.array(x) for v in (vectors[c], vectors[q]) for x in (sorted(v), [v[k] for k in sorted(v)]))) for c in n}
        best = sorted((-s, c) for c, s in pairs.items() if s)[: p.top_k]
        want += [(q, k + 1, c, n[c], -s) for k, (s, c) in enumerate(best)]
    assert sorted(map(tuple, again.answers().collect())) == want and want
    held = {}
    for i in [*range(6), 8]:
        for t in range(p.tables):
            held.setdefault((t, sigs[i, t]), []).append(i)
    got = {(r.tbl, r.bucket, r.doc_id, r.age) for r in standing.buckets(spark, f"{path}/buckets").collect()}
    assert got == {(t, b, i, k + 1) for (t, b), v in held.items() for k, i in enumerate(v[::-1][: p.capacity])}
    probed = again.probe(lsh.bucket_of(lsh.bit_sums(frame([9]).selectExpr("doc_id", "pos", "cast(round(w * 1000000) as bigint) AS q"), p), p).withColumnRenamed("doc_id", "query_id"))
    assert {(r.cand_id, r.tbl) for r in probed.collect()} == {(i, t) for (t, b), v in held.items() for i in v[-p.capacity :] if sigs[9, t] == b}


def test_crowded_buckets_are_cut_into_runs(spark, monkeypatch):
    """A bucket of most arrivals, one at the edge of a run, small ones: the same pairs as from one window each."""
    rng = np.random.default_rng(9)
    rows = [(int(i), 0, 5 if i % 3 else int(rng.integers(4))) for i in rng.permutation(300)] + [(int(i), 1, 2) for i in range(40)]
    sigs, p = spark.createDataFrame(rows, "doc_id long, tbl int, bucket int"), lsh.Params(capacity=7)
    want = sorted(map(tuple, lsh.query_then_insert(sigs, p).collect()))
    monkeypatch.setattr(lsh, "CROWDED", 32)
    got = lsh.query_then_insert(sigs, p)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 1500


def test_buckets_filled_alone_are_probed_without_vectors(spark):
    """Documents that only probes meet start no stream of vectors; the state holds packed queues."""
    p, path = lsh.Params(tables=2, bits=3, capacity=2), scratch_dir(spark, "standing")
    rows = spark.createDataFrame([(i, d, float(i % 3 - d)) for i in range(9) for d in range(3)], "doc_id long, pos long, w double")
    index = standing.Standing(spark, path, p)
    index.fill(rows, lsh.F.col("doc_id"))
    index.advance()
    index.fill(rows.withColumn("doc_id", lsh.F.col("doc_id") + 9), lsh.F.col("doc_id"))
    index.advance()
    assert not index._found("wanted") and not index._found("vectors")
    sigs = lsh.signatures(rows.selectExpr("doc_id", "pos", "cast(round(w * 1000000) as bigint) AS q"), p)
    line = {}
    for r in sorted(sigs.collect()):
        line.setdefault((r.tbl, r.bucket), []).append(r.doc_id)
    want = {(t, b, i, k + 1) for (t, b), v in line.items() for k, i in enumerate(([*v, *[i + 9 for i in v]])[::-1][: p.capacity])}
    assert set(map(tuple, standing.buckets(spark, f"{path}/buckets").collect())) == want
    assert dict(spark.read.format("statestore").option("stateVarName", "held").load(f"{path}/buckets").select("value.*").dtypes) == {"bucket": "binary", "id": "binary"}
