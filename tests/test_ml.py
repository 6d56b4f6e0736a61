import numpy as np
from pyspark.sql import functions as F

from nearlabel.operators import ml
from nearlabel.plans import registry

ml_train = ml.train


def test_indicator_has_every_label(spark, monkeypatch):
    """More labels than are broadcast: a row for every document and label all the same."""
    docs = spark.range(10_050).select(F.lit(1).alias("one"), F.concat(F.lit("l"), "id").alias("label")).groupBy("one").agg(F.collect_list("label").alias("labels"))
    docs = docs.select(F.lit(1).cast("long").alias("doc_id"), "labels").unionByName(spark.createDataFrame([(2, ["l7", "own"])], "doc_id long, labels array<string>"))
    rows = ml.indicator(docs)
    assert "CartesianProduct" in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.label): r.y for r in rows.collect()}
    labels = [*(f"l{i}" for i in range(10_050)), "own"]
    assert got == {(d, x): int(x != "own" if d == 1 else x in ("l7", "own")) for d in (1, 2) for x in labels}
    few = docs.filter("doc_id = 2")
    want = sorted(tuple(r) for r in ml.indicator(few).collect())
    monkeypatch.setattr(ml, "BROADCAST_LABELS", 1)
    assert sorted(tuple(r) for r in ml.indicator(few).collect()) == want == [(2, "l7", 1), (2, "own", 1)]


def test_svm_predicts_every_language(spark, monkeypatch):
    words = {"en": "house garden window", "nl": "huis tuin raam", "pl": "dom ogród okno"}
    rows = [(3 * i + k, f"{words[lang]} {words[lang].split()[i % 3]}", lang, "s") for i in range(12) for k, lang in enumerate(words)]
    monkeypatch.setattr(registry, "docs", lambda *_: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    monkeypatch.setattr(registry.ml, "train", lambda d: ml_train(d, components=3))
    got = {r.doc_id: r.labels for r in registry.queries()["svm_predict"](spark, "").collect()}
    assert got == {i: lang for i, _, lang, _ in rows}


def test_training_against_dense_algebra(spark):
    """All of it on a small corpus: weights, canonical components and machines by dense matrices predict the same labels."""
    rng = np.random.default_rng(6)
    words = [f"w{chr(97 + i)}x" for i in range(20)]
    topics = {"red": words[:6], "green": words[5:11], "blue": words[10:16]}
    rows = []
    for i in range(48):
        own = [t for t in topics if rng.random() < 0.45]
        text = [str(rng.choice(topics[t])) for t in own for _ in range(4)] + [str(x) for x in rng.choice(words, 2)]
        rows.append((i, " ".join(text) if i != 4 else None, own if i != 9 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels array<string>")
    got = {r.doc_id: r.labels for r in ml.train(docs).predict(docs).collect()}
    tokens = {r.doc_id: r.tokens for r in ml.analyzed(docs).select("doc_id", "tokens").collect()}
    names, terms = sorted(topics), sorted({t for v in tokens.values() for t in v})
    tf = np.array([[tokens[i].count(t) for t in terms] for i in range(48)], float)
    x = tf * (np.log(49 / (1 + (tf > 0).sum(axis=0))) + 1)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    y = np.array([[n in (own or []) for n in names] for _, _, own in rows], float)
    cx, cy = x - x.mean(axis=0), y - y.mean(axis=0)
    root = lambda g: (lambda v, u: u / np.sqrt(v) @ u.T)(*np.linalg.eigh(g))
    wx = root(cx.T @ cx + np.eye(len(terms)))
    p, _, _ = np.linalg.svd(wx @ cx.T @ cy @ root(cy.T @ cy + np.eye(3)))
    z = np.hstack([cx @ (wx @ p[:, :3]), np.ones((48, 1))])
    want = {}
    for j, name in enumerate(names):
        sign, w = np.where(y[:, j], 1.0, -1.0), np.zeros(4)
        curve = 2 * np.linalg.eigvalsh(z.T @ z).max() + 1
        for _ in range(20_000):
            w -= (-2 * (np.maximum(0, 1 - sign * (z @ w)) * sign) @ z + w * [1, 1, 1, 0]) / curve
        for i in range(48):
            want[i, name] = float(z[i] @ w)
    sure = [k for k, v in want.items() if abs(v) > 0.02]
    assert len(sure) > 130 and all((name in got[i]) == (want[i, name] > 0) for i, name in sure)
    assert [name for name in names if want[4, name] > 0] == got[4]


def test_texts_are_analyzed_once(spark, monkeypatch):
    """Terms, weights and what the query predicts come from one pass over the texts."""
    passes, analyzed = [], ml.analyzed
    monkeypatch.setattr(ml, "analyzed", lambda d: passes.append(1) or analyzed(d))
    rows = [(i, ["red house", "blue garden", None][i % 3], ["a", "b", "a"][i % 3], "s") for i in range(9)]
    monkeypatch.setattr(registry, "docs", lambda *_: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert registry.queries()["svm_predict"](spark, "").count() == 9 and len(passes) == 1


def test_words_are_found_at_once(spark):
    """Texts with names, links and tags, and without: the words of ``plain_words`` between breaks, no stop words, stems."""
    texts = ["The Houses, the gardens_x a b2 été x-ray", "see HTTP://x.y/z and @name houses", "#tagged#words http", "", None, "it's   not\nrunning (a)b", "mail a@b.c walking", "wHttp https-like ahttp"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    stop = set(ml.StopWordsRemover.loadDefaultStopWords("english"))
    words = F.filter(F.split(ml.T.plain_words(F.coalesce("text", F.lit(""))), r"\W+"), lambda w: F.length(w) > 1)
    want = {r.doc_id: [ml.stem(w) for w in r.words if w not in stop] for r in docs.select("doc_id", words.alias("words")).collect()}
    found = ml.analyzed(docs)
    assert {r.doc_id: r.tokens for r in found.collect()} == want and want[0][:1] == ["hous"]
    assert "split" not in found.select("tokens")._jdf.queryExecution().optimizedPlan().toString().split("ELSE")[-1]
