import numpy as np
import pyarrow as pa
import pytest

from nearlabel.functions import text as T
from nearlabel.operators import dictionary as D
from nearlabel.operators import postings
from nearlabel.operators.graph import cut
from nearlabel.plans import registry
from nearlabel.session import scratch_dir, table


def test_codes():
    rng = np.random.default_rng(1)
    values = np.concatenate([[0, 1, 127, 128, 2**53 + 1, 2**62], rng.integers(0, 2 ** rng.integers(1, 62, 500))])
    starts = np.array([0, 3, 6, 200])
    parts = [postings.decoded(b) for b in postings.coded(values, starts)]
    assert [p.tolist() for p in parts] == [values[a:b].tolist() for a, b in zip(starts, [3, 6, 200, len(values)], strict=True)]
    assert postings.decoded(b"").tolist() == []


def test_index_grows_and_merges(spark):
    """Appends, a merge, an append after it; a word of every document, a document that comes twice, far and negative ids."""
    rows = [("all", i, 1 + i % 3) for i in range(700)] + [("odd", i, 2) for i in range(1, 700, 2)] + [("far", -5, 1), ("far", 2**60, 9), ("", 3, 1)]
    df = spark.createDataFrame(rows, "token string, doc_id long, tf long")
    index = postings.Index(spark, scratch_dir(spark, "index"))
    assert index.lookup().count() == 0
    for k in range(3):
        index.append(df.filter(f"pmod(doc_id, 3) = {k}"))
    got = lambda t=None: sorted(map(tuple, index.lookup(t).collect()))
    assert got() == sorted(rows)
    before = index.blocks().count()
    index.merge()
    assert got() == sorted(rows) and index.blocks().count() < before
    index.append(spark.createDataFrame([("all", 700, 4), ("all", 5, 10)], "token string, doc_id long, tf long"))
    assert got(spark.createDataFrame([("far",), ("none",)], "token string")) == [("far", -5, 1), ("far", 2**60, 9)]
    index.merge()
    assert [r for r in got() if r[:2] == ("all", 5)] == [("all", 5, 13)] and len(got()) == len(rows) + 1
    assert max(r.n for r in index.blocks().collect()) <= postings.BLOCK


def brute(queries, docs, n):
    size = lambda v: np.sqrt(sum(w * w for w in v.values()))
    out = []
    for q, a in queries.items():
        scored = [(-round(sum(w * b[p] for p, w in a.items() if p in b) / (size(a) * size(b)), 6), d) for d, b in docs.items() if a.keys() & b.keys()]
        out += [(q, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scored)[:n])]
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 3])
def test_search_brute_force(spark, monkeypatch, shards):
    monkeypatch.setattr(postings, "STEP", 4)
    rng = np.random.default_rng(3)
    made = lambda k, n: {i: {int(p): float(rng.exponential() / (1 + p) if p % 4 else 0.5) for p in rng.zipf(1.3, n) if p < 60} for i in range(k)}
    docs = {i: v for i, v in made(400, 14).items() if v}
    docs |= {1000 + i: docs[next(iter(docs))] for i in range(9)}  # ties
    queries = {i: v for i, v in made(25, 6).items() if v} | {99: {77: 1.0}}
    frame = lambda vs, key: spark.createDataFrame([(i, p, w) for i, v in vs.items() for p, w in v.items()], f"{key} long, pos long, w double")
    q, d = frame(queries, "query_id"), frame(docs, "doc_id")
    found = postings.search(q, d, 5, shards).filter("cand_id IS NOT NULL")
    got = sorted(map(tuple, postings.top_n(found, 5, "cos_sim").select("query_id", "rank", "cand_id", "cos_sim").collect()))
    assert got == brute(queries, docs, 5)
    assert postings.more_like_this(q, d.limit(0)).count() == 0 and postings.more_like_this(q.limit(0), d).count() == 0


def test_search_reads_less_than_half(spark):
    """Passages against the table's documents: most postings of their words stay shut."""
    sf = "/root/testdata/sf0.01"
    d = registry.docs(spark, sf).select("doc_id", T.words(registry.F.col("text")).alias("tokens"))
    tf = cut(D.term_freq(d, registry.F.col("tokens")), "tf")
    entries = cut(D.of_terms(tf, d), "dictionary")
    items = table(spark, sf, "benchmark").select(registry.F.col("item_id").alias("doc_id"), T.words(registry.F.col("text")).alias("tokens"))
    q = D.tfidf(D.term_freq(items, registry.F.col("tokens")), entries).withColumnRenamed("doc_id", "query_id")
    cost = postings.search(q, D.tfidf(tf, entries), 10).filter("cand_id IS NULL").agg({"read": "sum", "postings": "sum"}).first()
    share = cost["sum(read)"] / cost["sum(postings)"]
    print("share of postings read", share)
    assert share < 0.5


def test_blocks_are_decoded_side_by_side(monkeypatch):
    """All blocks of a batch in one pass over their bytes, whatever their sizes; a slice of a batch too."""
    rng, calls, real = np.random.default_rng(3), [], postings.decoded
    rows = [(f"t{t}", int(d), int(c)) for t in range(40) for d, c in zip(np.unique(rng.integers(-(1 << 40), 1 << 60, 1 + t * 9)), rng.integers(0, 1 << 20, 400), strict=False)]
    batch = pa.RecordBatch.from_pydict({"token": pa.array([r[0] for r in rows]), "doc_id": pa.array([r[1] for r in rows], pa.int64()), "tf": pa.array([r[2] for r in rows], pa.int64())})
    blocks = next(postings._encode([batch]))
    monkeypatch.setattr(postings, "decoded", lambda x: calls.append(1) or real(x))
    for part in (blocks, blocks.slice(7)):
        got = [tuple(r.values()) for b in postings._decode([part]) for r in b.to_pylist()]
        assert got == rows[-len(got) :] and len(got) == sum(part.column("n").to_pylist())
    assert len(calls) == 4
