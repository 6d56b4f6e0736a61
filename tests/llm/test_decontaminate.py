import hashlib
import random
import re

from pyspark.sql import functions as F

from nearlabel.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - 9, min(len(w), 1))):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    sizes = {len(x) for x in windows}
    out = {}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= own
                    hit |= set(range(k, k + n))
        ids = sorted(str(i) for i in found if i is not None)
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


def rows(df):
    df = df.withColumn("sha", F.sha2(F.array_join("items", ","), 256))
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.sha, r.contaminated) for r in df.collect()}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.op8_decontaminate(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(docs, items) and any(r.contaminated for r in got)
    assert len(got) == len(docs)


def made(spark, seed=7, n=300):
    rnd = random.Random(seed)
    vocab = [*"abcdefgh", "É", "é", "x1"]
    say = lambda a, z: rnd.choice([" ", ", "]).join(rnd.choice(vocab) for _ in range(rnd.randint(a, z)))
    items = [(k, say(1, 14)) for k in range(40)] + [(100, None), (101, "..."), (7, say(12, 20)), (None, say(10, 12))]
    docs = [(k, " ".join([say(0, 9)] + [(i[1] or "").upper().replace("É", "é") if rnd.random() < 0.5 else i[1] or "" for i in rnd.sample(items, 1)] + [say(0, 9)])) for k in range(n)]
    docs += [(-1, None), (-2, ""), (-3, "w " * 20000), (-4, items[42][1])]
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_words string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_fuzz_against_brute_force(spark, monkeypatch):
    d, b, docs, items = made(spark)
    assert rows(decontaminate.contamination(d, b)) == brute(docs, items)
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(decontaminate, "BITS", 1 << 12)
    assert rows(decontaminate.contamination(d.union(d), b)) == brute(docs, items)


def test_only_long_items(spark):
    d, b, docs, items = made(spark, 9, 400)
    keep = [i for i in items if len(words(i[1])) >= 10]
    assert rows(decontaminate.contamination(d, spark.createDataFrame(keep, b.schema))) == brute(docs, keep)


def test_empty_tables(spark):
    d, b, docs, items = made(spark, 1, 5)
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    assert rows(decontaminate.contamination(d, b.limit(0))) == brute(docs, [])


def test_no_python_in_the_plan(spark, sf):
    plan = queries.op8_decontaminate(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
