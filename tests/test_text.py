"""Exact expectations: text rules, identifiers, dates, statistics, graph, sources."""

import json
import math

import pytest
from pyspark.sql import functions as F

from nearlabel.functions import text as T
from nearlabel.functions import vectors as V
from nearlabel.operators import dictionary as D
from nearlabel.operators import graph, lsh, ml, suggest
from nearlabel.sources import io


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(f(*[F.col(f"c{k}") for k in range(len(values))]).alias("v")).first().v


@pytest.mark.parametrize(
    "f,text,want",
    [
        (T.preprocess, "RT @a: I will get 5 dogs good ARTIST 10 &amp; #tag www.x.com a1b2 tooooo 7", "  I wil get  god AIST  & tag w.x.com a to 7"),
        (T.preprocess, None, None), (T.preprocess, "", ""),
        (T.generated_id, "Stick to the plan OPM", "-8178818579571153902"), (T.generated_id, "emoji 😀 x", "8503917685101532"),
        (T.generated_id, "a much longer text that wraps around many times é", "2219794823701121722"), (T.generated_id, "", "7"),
        (T.created_at, "Fri Jun 13 02:06:38 +0000 2014", "2014-06-13 02:06+0000"),
        (T.words, "A b,c $5 <x> £é_9", ["a", "b", "c", "$5", "<x>", "£", "_9"]), (T.words, "", []),
        (T.word_set, "RT b a b 12,3 http://x.y/z @me c", ["a", "b", "c"]), (T.clean_for_index, "RT @n: Go #x!", " go x "),
        (T.labels_from_json, '[{"text":"a"},{"text":"b"}]', "a b"), (T.labels_from_json, "[]", None),
        (T.encoded_query, "a b", "a%2520b"), (T.split_labels, "a,b c", ["a", "b", "c"]), (T.plain_words, "#Go @me http://x Now", "go now"),
        (T.remove_links_and_replies, "see http://x.y z @me", "see  z"),
    ],
)
def test_text_rules(spark, f, text, want):
    assert one(spark, f, text) == want


def test_stems():
    """Examples of the published algorithm and of its vocabulary list."""
    pairs = {"consign": "consign", "consigned": "consign", "consigning": "consign", "consist": "consist", "consistency": "consist", "consistently": "consist", "consolatory": "consolatori", "consoles": "consol", "consolingly": "consol", "conspicuously": "conspicu", "conspirators": "conspir", "constable": "constabl", "knack": "knack", "kneeled": "kneel", "knees": "knee", "knightly": "knight", "knives": "knive", "knocker": "knocker", "knotty": "knotti", "caresses": "caress", "ties": "tie", "cries": "cri", "gaps": "gap", "gas": "gas", "kiwis": "kiwi", "this": "this", "luxuriating": "luxuri", "hopping": "hop", "hoping": "hope", "falling": "fall", "by": "by", "say": "say", "cry": "cri", "generously": "generous", "skies": "sky", "news": "news", "herring": "herring", "exceeds": "exceed", "agreed": "agre", "relational": "relat", "rational": "ration", "analogi": "analog", "controll": "control", "youth": "youth", "é": "é", "is": "is"}
    assert {w: ml.stem(w) for w in pairs} == pairs


def test_search_terms(spark):
    got = one(spark, ml.search_terms, "The Foxes' fox's RUNNING, and it isn't 42nd; Café-bars")
    assert got == ["fox", "fox", "run", "isn't", "42nd", "café", "bar"]
    assert one(spark, ml.search_terms, "") == one(spark, ml.search_terms, None) == []


def test_dictionary(spark):
    docs = spark.createDataFrame([(0, "b a a"), (1, "a c"), (2, None), (3, "")], "doc_id long, text string")
    d = {r.token: (r.df, r.position) for r in D.build(docs, T.words(F.col("text")), least=1).collect()}
    assert d == {"a": (2, 0), "b": (1, 1), "c": (1, 2)}
    n = spark.createDataFrame([(1000, 9)], "n long, df long").select(D.idf(F.col("n"), F.col("df")).alias("i")).first().i
    assert math.isclose(n, math.log(1000) / 10)
    df = spark.createDataFrame([("u", 3), ("ya", 2), ("you", 5), ("x", 1)], "token string, df long")
    v = spark.createDataFrame([("u", "you"), ("ya", "you"), ("zz", "none")], "variant string, normal string")
    assert {r.token: r.df for r in D.merge_variants(df, v).collect()} == {"you": 10, "x": 1, "u": 10, "ya": 10}


def test_first_seen_and_ranks(spark):
    rows = spark.createDataFrame([("z", 1), ("a", 1), ("b", 0), ("z", 5)], "token string, seq long")
    assert {r.token: r.position for r in D.first_seen(rows).collect()} == {"b": 0, "a": 1, "z": 2}
    many = spark.range(1000).select(F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("token"))
    assert [r.position for r in D.positions(many).orderBy("token").collect()] == list(range(1000))


def test_cosine_and_norms(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r.c for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [1.0, None]


def test_buckets_hold_the_latest(spark):
    sigs = spark.range(201).select(F.col("id").alias("doc_id"), F.lit(0).alias("tbl"), F.lit(5).alias("bucket"))
    p = lsh.Params()
    assert {r.doc_id for r in lsh.kept(sigs, p).collect()} == set(range(1, 201))
    assert lsh.query_then_insert(sigs, p).filter("doc_id = 200").count() == 200


def test_equal_vectors_meet_in_all_tables(spark):
    rows = spark.createDataFrame([(d, k, 1000 * k - 3000) for d in (1, 2) for k in range(8)], "doc_id long, pos int, q long")
    sigs = lsh.signatures(rows, lsh.Params())
    assert sigs.groupBy("tbl").agg(F.count_distinct("bucket").alias("n")).filter("n = 1").count() == 36


def test_request_path(spark):
    docs = [(k, f"alpha beta{k % 3} gamma{k % 5} delta") for k in range(30)] + [(99, "unrelated words only")]
    labelled = spark.createDataFrame([(k, t, [f"l{k % 3}"]) for k, t in docs], "doc_id long, text string, labels array<string>")
    got = suggest.suggest(spark, ["alpha beta1 gamma2", "nothing known", ""], labelled, lsh.Params(tables=12, bits=4)).collect()
    assert {r.query_id for r in got} == {0} and got[0].cos_sim > 0.5 and got[0].labels == ["l1"]


def test_suggestion_rules(spark):
    rows = [(1, 1, 0.9, ["a", "b", "c"]), (1, 2, 0.8, ["d", "e", "f"]), (1, 3, 0.3, ["g"]), (1, 4, 0.1, ["h"])]
    df = spark.createDataFrame(rows, "query_id long, rank int, cos_sim double, labels array<string>")
    assert sorted(r.label for r in suggest.by_neighbours(df).collect()) == list("abcdefg")
    assert sorted(r.label for r in suggest.by_search(df).collect()) == list("abcdef")
    body = json.loads(suggest.response(suggest.by_search(df), df.withColumn("cand_id", F.col("rank"))).first().body)
    assert body["suggestions"] == list("abcdef") and len(body["similar"]) == 4


GRAPH = ["0", "1 4 7", "2 3 8", "3 5", "4 1", "5 6", "6", "7", "8 3", "9 0", " "]


def test_graph(spark):
    v = graph.adjacency(spark.createDataFrame([(x,) for x in GRAPH], "value string"))
    edges = graph.edges_of(v).union(v.select("id", "id"))
    want = {0: 0, 1: 1, 2: 2, 3: 2, 4: 1, 5: 2, 6: 2, 7: 1, 8: 2, 9: 0}
    assert {r.id: r.label for r in graph.connected_components(edges).collect()} == want
    directed = {r.id: r.label for r in graph.min_label_directed(v).collect()}
    assert directed[9] == 0 and directed[6] == 2 and directed[7] == 1
    chain = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.label for r in graph.connected_components(chain).collect()} == {0}


def test_sources(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("2\tto\nu\tyou\n2\ttoo\nbad\n")
    assert {r.variant: r.normal for r in io.variants(spark, f"{tmp_path}/v.tsv").collect()} == {"2": "too", "u": "you"}
    (tmp_path / "s.ini").write_text("[default]\na = 1\n")
    assert io.settings(f"{tmp_path}/s.ini")["a"] == "1"
    raw = spark.createDataFrame([(json.dumps(o),) for o in ({"id": 5, "text": "t", "lang": "en", "created_at": "x", "entities": {"labels": [{"text": "a"}]}}, {"delete": {"x": 1}}, {"id": 6, "text": "", "lang": "en", "created_at": "x"})], "value string")
    parsed = raw.select(F.from_json("value", io.raw_schema()).alias("v")).select("v.*")
    ok = parsed.filter(io.is_valid(parsed))
    assert [(r.id, r.labels) for r in io.messages(ok).collect()] == [("5", ["a"])]
    io.write_csv(spark.createDataFrame([("a", 1)], "token string, df long"), f"{tmp_path}/c")
    assert io.counts_csv(spark, f"{tmp_path}/c").collect() == [("a", 1)]
    docs = spark.range(25).withColumnRenamed("id", "k")
    assert sum(len(json.loads(r.body)) for r in io.search_batches(docs, "k", 10).collect()) == 25
    maps = io.json_maps(raw, "value")
    assert [r.m.get("text") for r in maps.collect()] == ["t", None, ""]
    sent = spark.createDataFrame([("1", "x", ["a", "b"]), ("2", None, [])], io.MESSAGE)
    io.write_json(sent, f"{tmp_path}/j")
    assert sorted(map(tuple, io.json_lines(spark, [f"{tmp_path}/j"]).collect())) == sorted(map(tuple, sent.collect()))
    hours = spark.createDataFrame([(1, "2024-01-02 03:04:05"), (2, "2024-01-02 03:59:59"), (3, "2024-01-02 04:00:00")], "id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    io.write_archive(hours, f"{tmp_path}/a")
    assert {r.dt_hour: r["count"] for r in spark.read.option("inferSchema", "false").parquet(f"{tmp_path}/a").groupBy("dt_hour").count().collect()} == {"20240102_03": 2, "20240102_04": 1}
    assert io.request_form('{"text": "x"}') == "x" and io.requests(spark, ["a", "", None]).count() == 1


def test_streams(spark, tmp_path):
    from nearlabel.streaming import jobs

    rows = spark.createDataFrame([("b", 0), ("a", 1)], "token string, seq long")
    merge = jobs.merge_positions(f"{tmp_path}/p")
    merge(rows, 0)
    merge(spark.createDataFrame([("c", 2), ("a", 3)], "token string, seq long"), 1)
    merge(spark.createDataFrame([("c", 2), ("a", 3)], "token string, seq long"), 1)
    assert {r.token: r.position for r in spark.read.parquet(f"{tmp_path}/p").collect()} == {"b": 0, "a": 1, "c": 2}
    put = jobs.upsert_into(f"{tmp_path}/u", "k", "v")
    put(spark.createDataFrame([(1, 1), (2, 1)], "k long, v long"), 0)
    put(spark.createDataFrame([(1, 2)], "k long, v long"), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/u/v1").collect()) == [(1, 2), (2, 1)]


def test_supervised_restarts(spark):
    """After an error the query starts again from its checkpoint; too many errors end it."""
    from nearlabel.streaming import jobs

    class Query:
        def __init__(self, bad):
            self.bad = bad

        def awaitTermination(self):  # noqa: N802
            if self.bad:
                raise RuntimeError("gone")

    began = []
    jobs.supervised(lambda: began.append(1) or Query(len(began) < 3), wait=0.01)
    assert len(began) == 3
    with pytest.raises(RuntimeError):
        jobs.supervised(lambda: Query(True), attempts=2, wait=0.01)


def test_search_rule_of_lists(spark):
    """compat: each distinct label list counts once, by first rank, and labels may come again with another list."""
    rows = [(1, 1, ["a", "b"]), (1, 2, ["a", "b"]), (1, 3, ["a", "c", "d", "e"]), (1, 4, ["f"]), (2, 1, [])]
    df = spark.createDataFrame(rows, "query_id long, rank int, labels array<string>")
    got = sorted(map(tuple, suggest.by_search(df, compat=True).collect()))
    assert got == [(1, 1, "a"), (1, 1, "b"), (1, 3, "a"), (1, 3, "c"), (1, 3, "d"), (1, 3, "e")]
    assert sorted(map(tuple, suggest.by_search(df).collect())) == [(1, 1, "a"), (1, 1, "b"), (1, 3, "c"), (1, 3, "d"), (1, 3, "e"), (1, 4, "f")]


def test_running_count_over_partitions(spark):
    rows = spark.range(1000).select(F.floor(F.col("id") / 7).alias("batch"), "id")
    got = {r.batch: r.d for r in D.running_count(rows).collect()}
    assert got == {b: min(1000, 7 * (b + 1)) for b in range(143)}


def test_work_dir_needs_a_shared_folder(spark):
    from nearlabel import session

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = Context()  # noqa: N815

    with pytest.raises(ValueError):
        session.work_dir(Session())


def test_words_are_taken_in_one_pass(spark):
    """Tokens are found, not what is left between breaks; signs of any width break them."""
    texts = ["", " .,", "a", "Ab-c\U0001f600d_£1$% <x>\u00e9y\n\nEnd.", None, "\u0130x \ud55cz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.words(F.col("t")).alias("w"))
    by_split = F.filter(F.split(F.lower("t"), r"[^A-Za-z0-9_£$%<>]"), lambda w: w != "")
    want = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", by_split.alias("w"))
    assert df.collect() == want.collect() and df.collect()[3].w == ["ab", "c", "d_£1$%", "<x>", "y", "end"]
    assert "split" not in df._jdf.queryExecution().toString()
