import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from nearlabel.functions import text as T
from nearlabel.operators import chunks, lsh
from nearlabel.operators import dictionary as D

ODD = [
    "Aaa bb\n\tccc  £5 a£b x_$%<>y RT this #tag &amp; ammp &ammp; see http://x.y/zz or www. q @name 1 st 20 books",
    "www.zz wwww. aa nbsp", "", None, "\u212a\u0130x A\u212a \u0130", "İIK Kelvin Éée aAa  zz", "£", "££ £¢ Â ⾣x", "word " * 40, "R#T RTT rt rrt 0aa 09 bb", "a", " a\x0bb\x0c\x1cc\x85d",
]


def test_words_equal_the_rules_of_texts(spark, monkeypatch):
    """Odd texts, documents in several rows, chunks of a few documents: the same words as from the patterns, counted."""
    monkeypatch.setattr(chunks, "CHUNK", 200)
    rng = np.random.default_rng(3)
    texts = [*ODD, *("".join(rng.choice(list("aabbÉ£zZ 1@#&\nRT.K<"), 60)) for _ in range(60)), *("".join(rng.choice(list("aabBÉ£zZ \n.<"), 60)) for _ in range(60))]
    docs = spark.createDataFrame([(i % 70 if i % 70 != 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for clean, words in ((True, T.words(T.preprocess(F.col("text")))), (False, T.words(F.col("text")))):
        want = {(r.doc_id, r.token): r.tf for r in D.term_freq(docs, words).collect()}
        got, rows = {}, chunks.pack(docs, clean).collect()
        for r in rows:
            doc = np.repeat(np.arange(len(r.sizes)), r.sizes)
            for d, a, n in zip(doc, np.frombuffer(r.at, np.int32), np.frombuffer(r.tf, np.int32), strict=True):
                assert (r.ids[d], r.words[a]) not in got
                got[r.ids[d], r.words[a]] = int(n)
            assert r.df == np.bincount(np.frombuffer(r.at, np.int32), minlength=len(r.words)).tolist()
        assert got == want and len(rows) > 8 and len({r.chunk for r in rows}) == len(rows)


def test_vectors_equal_those_of_rows(spark, sf, monkeypatch):
    """Dictionary, weights and buckets as from a row a document and word, and these rows are moved by chunk alone."""
    monkeypatch.setattr(chunks, "CHUNK", 100_000)
    docs, p = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), lsh.Params(tables=5, bits=9)
    packed = chunks.pack(docs, clean=True)
    known = chunks.entries(packed, docs)
    tf = D.term_freq(docs, T.words(T.preprocess(F.col("text"))))
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, D.of_terms(tf, docs).collect()))
    got, want = chunks.vectors(packed, known, p, lsh.signs(known, p)), D.tfidf(tf, known)
    assert sorted(map(tuple, chunks.unpacked(got).collect())) == sorted(map(tuple, want.collect()))
    sigs = lsh.signatures(want.select("doc_id", "pos", F.round(F.col("w") * 1_000_000).cast("bigint").alias("q")), p)
    assert sorted(map(tuple, chunks.signatures(got).collect())) == sorted(map(tuple, sigs.collect())) and packed.count() > 3


def test_texts_of_a_pass_are_found_together():
    words, n = chunks.found(pa.array(["Aaa b", "", "££x aa", "zz"]).slice(1), np.array([False, True, False]))
    assert words.to_pylist() == ["££x", "a", "zz"] and n.tolist() == [0, 2, 1]


def test_rare_words_need_no_room(spark, monkeypatch):
    """Of a dictionary of more words than are kept, those with the most documents are sent; the others get the same planes."""
    monkeypatch.setattr(lsh, "KNOWN", 3)
    p, rows = lsh.Params(tables=3, bits=5), [(i, [9, 2, 7, 2, 5][i]) for i in range(5)]
    held, bits = lsh.signs(spark.createDataFrame(rows, "position long, df long"), p).value
    assert held.tolist() == [0, 2, 4]
    planes, pos = lsh.Planes(p), np.array([4, 1, 0, 3])
    assert (planes.fetched(pos, (held, bits)) == planes.made(pos.tolist())).all()
    assert (planes.fetched(pos, (held[:0], bits[:0])) == planes.made(pos.tolist())).all()


def test_online_vectors_by_chunks(spark, sf, monkeypatch):
    """Chunks of a few batches give what a row a document and word gives, and so do batches that are too large for them;
    no row a document and word is moved."""
    monkeypatch.setattr(chunks, "CHUNK", 20_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", (F.col("doc_id") / 7).cast("long").alias("batch"), "text")
    docs = docs.union(spark.createDataFrame([(3, 0, "again the text"), (100_000, 14_285, None), (100_001, 14_285, "x. Y, \u212ay")], docs.schema))
    sorted_rows = lambda df: sorted(map(tuple, df.withColumn("w", F.round("w", 6)).collect()))
    want = sorted_rows(D.online_vectors(docs.select("doc_id", "batch", T.words(F.col("text")).alias("tokens"))))
    got = chunks.online(docs)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString() and sorted_rows(got) == want
    monkeypatch.setattr(chunks, "BATCH", 10)
    assert sorted_rows(chunks.online(docs)) == want
