import re

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from nearlabel.llm import queries, toxicity
from nearlabel.llm.pieces import vocabulary
from nearlabel.operators.graph import cut

from .test_decontaminate import brute as leaks
from .test_fragment_join import brute as groups
from .test_secrets import brute as found


def test_every_stage_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = {}
    for name, stage in cp.STAGES:
        frames[name] = docs
        docs = cut(stage(spark, docs, sf))
    frames["end"] = docs
    texts = {k: {r.doc_id: r.text for r in frames[k].collect()} for k in list(frames)[:-1]}
    model = toxicity.fit(frames["toxicity"].select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet").filter(~queries.held_out("doc_id")))
    scored = toxicity.Scorer(model).score(list(texts["toxicity"].values()))
    assert set(texts["near duplicates"]) == {d for d, (score, _) in zip(texts["toxicity"], scored, strict=True) if score < 0.7}
    one = groups(list(texts["near duplicates"].items()), 5, 80, 100)
    assert set(texts["benchmark passages"]) == {d for d, (_, c) in one.items() if c == d} != set(texts["near duplicates"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = leaks(list(texts["benchmark passages"].items()), items)
    assert set(texts["secret scans"]) == {d for d, r in held.items() if not r[4]} != set(texts["benchmark passages"])
    for d, t in texts["secret scans"].items():
        if not found(t):
            assert texts["packing"][d] == t or re.search("eyJ|ghp_|xox|BEGIN", t)
        assert not found(texts["packing"][d])
    assert all(r.n_chars == len(r.text) for r in frames["packing"].collect())
    assert frames["packing"].columns == list(cp.COLUMNS)
    tok, got = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), {}
    for r in frames["end"].collect():
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for d, t in texts["packing"].items():
        assert [i for _, ids in sorted(got[d]) for i in ids] == [*tok.encode(t, add_special_tokens=False).ids, 2]


def test_odd_tables(spark, tmp_path):
    """Null keys and texts, repeated rows and keys, ties, a very long text, extra columns, empty tables, stage by stage."""
    words = lambda k, n: " ".join(f"w{(k * 37 + j * j) % 991}" for j in range(n))
    rows = [(k, words(k, 40), "en", "s", 1) for k in range(60)]
    odd = [(100, words(1, 40), "en", "s", 1), (100, words(1, 40), "en", "s", 1), (1, words(1, 40), "en", "s", 1), (101, None, None, None, None), (101, None, None, None, None), (102, "", "en", "s", 0)]
    odd += [(None, words(2, 40) + " x", "en", "s", 1), (None, words(700, 30), "en", "s", 1), (2, words(800, 30), "en", "s", 1), (103, words(5, 300_000) + " token=abcdefgh12", "en", "s", 1), (104, "a " + words(900, 12), "en", "s", 1)]
    sf = f"{tmp_path}/sf"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = {c: F.lit("x") for c in ("label", "cid", "evidence", "score", "key", "words", "row", "h")}
    spark.createDataFrame(rows + odd, schema).withColumns(extra).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, int(k % 9 == 0)) for k in range(0)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, words(900, 12)), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in cp.STAGES:
        docs = cut(stage(spark, docs, sf))
        kept.append(docs)
    toxic, near, clean, safe = ([(r.doc_id, r.text) for r in f.collect()] for f in kept[:4])
    key = lambda rows: sorted(rows, key=str)
    assert key(toxic) == key([(r[0], r[1]) for r in rows + odd])
    want = [(r[0], r[1]) for r in rows] + [(101, None), (102, ""), (None, words(700, 30)), (2, words(800, 30)), (103, odd[9][1]), (104, odd[10][1])]
    assert key(near) == key(want)
    assert key(clean) == key([x for x in want if x[0] != 104])
    assert key(safe) == key([(d, t.replace("token=abcdefgh12", "[assign]") if t else t) for d, t in want if d != 104])
    assert all(f.columns == list(cp.COLUMNS) for f in kept[:4]) and kept[4].select("doc_id").distinct().count() == len({d for d, _ in safe})
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
