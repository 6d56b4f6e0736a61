import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from nearlabel.llm import queries, toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    good = [r.score for r in rows if not r.toxic]
    bad = [r.score for r in rows if r.toxic]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    caught, wrong = np.mean(np.array(bad) >= 0.7), np.mean(np.array(good) >= 0.7)
    print(auc, caught, wrong, np.mean((np.array(good + bad) - np.array([0] * len(good) + [1] * len(bad))) ** 2))
    assert auc > 0.95 and caught > 0.7 and wrong < 0.01


def test_nearest_is_exact():
    rnd = random.Random(4)
    entries = {}
    for k in range(900):
        ids = tuple(sorted(rnd.sample(range(6 if k % 3 else 60), rnd.randint(1, 6))))
        w = np.array([rnd.random() + 0.1 for _ in ids])
        entries[ids] = (np.array(ids, np.int32), (w / np.linalg.norm(w)).astype(np.float32), rnd.randint(0, 2), 1, k)
    index = toxicity.Index(list(entries.values()), 65)
    by_name = {e[4]: dict(zip(e[0].tolist(), e[1].tolist(), strict=True)) for e in entries.values()}
    ways = set()
    for j in range(120):
        q = {t: rnd.random() for t in rnd.sample(range(65), 1 + j % 5)}
        want = np.array([sum(q.get(t, 0) * w for t, w in by_name[n].items()) for n in index.name.tolist()])
        ids, weights = np.array(sorted(q), np.int32), np.array([q[t] for t in sorted(q)])
        bound = index.parts(ids, weights)[2]
        assert all(bound[k // toxicity.BLOCK] >= s - 1e-6 for k, s in enumerate(want))
        near, cosines = index.nearest(ids, weights, 7)
        ways.add(bool((bound < cosines[6:7].sum() - 1e-6).any()))
        best = sorted((-s, k) for k, s in enumerate(want) if s > 0)[:7]
        assert np.allclose(cosines[:7], [-s for s, _ in best]) and set(near[:7].tolist()) >= {k for s, k in best if s < best[-1][0] - 1e-6}
        assert np.allclose(cosines, want[near])
    assert ways == {True, False}


def test_query_against_brute_force(spark):
    """Neighbours and scores of the whole query, from all words of all texts, without an index."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    words = {d: Counter(re.findall(r"\w+", (t or "").lower())) for d, t in docs.items()}
    known = sorted(d for d in labels if d in docs)
    held = Counter(t for d in known for w in words[d] for t in {w + " "})
    begins = Counter(), Counter()
    for d in known:
        begins[1 - labels[d]].update({t for w in words[d] for t in [w + " ", *(w[:n] for n in (4, 5, 6, 7) if n <= len(w))]})
    toxic, base = sum(labels[d] for d in known), sum(labels[d] for d in known) / len(known)
    n = sum(begins[0][t] + begins[1][t] >= 4 for t in begins[0] | begins[1])
    strong = set()
    for t, a in begins[0].items():
        b = begins[1][t]
        r = a / (a + b)
        if a >= 4 and r > base and 2 * (a * math.log(r / base) + (b * math.log((1 - r) / (1 - base)) if b else 0)) > 2 * math.log(n):
            strong.add(t)
    terms = set(held) | strong

    def counts(d):
        out = Counter()
        for w, k in words[d].items():
            for t in [w + " ", *(w[:m] for m in (4, 5, 6, 7) if m <= len(w))]:
                if t in terms:
                    out[t] += k
        return out

    count = {d: counts(d) for d in docs}
    df = Counter(t for c in count.values() for t in c)
    vectors = {}
    for d, c in count.items():
        v = {t: (1 + math.log(k)) * (math.log((1 + len(docs)) / (1 + df[t])) + 1e-3) * (3 if t in strong else 1) for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[d] = {t: x / norm for t, x in v.items()} if norm else {}
    merged = {}
    for d in known:
        if vectors[d]:
            own = merged.setdefault(tuple(sorted((t, round(x, 9)) for t, x in vectors[d].items())), [d, 0, 0])
            own[2 - labels[d]] += 1
    near = {}
    rows = queries.op3_toxicity(spark, sf).collect()
    assert len(rows) == len(docs) and toxic
    for r in rows:
        sims = sorted(((-sum(vectors[r.doc_id].get(t, 0) * x for t, x in key), own[0], own[1] / (own[1] + own[2])) for key, own in merged.items()))
        want = [(-s, share) for s, _, share in sims[:3] if s < 0]
        got = [(e["cosine"], e["toxic_share"]) for e in json.loads(r.evidence)]
        assert np.allclose([c for c, _ in got], [c for c, _ in want], atol=1e-6)
        near[r.doc_id] = {d for s, d, _ in sims if s < 0 and s <= sims[min(2, len(sims) - 1)][0] + 1e-6}
        assert {e["doc_id"] for e in json.loads(r.evidence)} <= near[r.doc_id]
    assert sum(bool(x) for x in near.values()) > 0.9 * len(docs)

    # votes of the nearest, calibrated on examples by all others, give score and prediction
    entries = [(dict(key), own[1], own[2]) for key, own in merged.items()]
    place = {key: k for k, key in enumerate(merged)}
    prior = (toxic + 0.5) / (len(known) + 1)
    bare = [labels[d] for d in known if not vectors[d]]

    def vote(v, less=None):
        sims = sorted(((sum(v.get(t, 0) * x for t, x in e.items()), k) for k, (e, _, _) in enumerate(entries)), key=lambda x: -x[0])
        most = toxicity.NEIGHBOURS + bool(less)
        last = sims[min(most, len(sims)) - 1][0]
        up = down = toxicity.PRIOR
        up *= prior
        found = [(c, k) for c, k in sims if c > 1e-9 and c >= last - 1e-9]
        for c, k in found:
            t, o = entries[k][1:]
            if less and k == less[0]:
                t, o = t - less[1], o - (1 - less[1])
            if t + o:
                w = c * c / (1.05 - min(c, 1)) * math.log2(1 + t + o)
                up, down = up + w * t / (t + o), down + w
        return up / down if found else None

    pairs = sorted((vote(vectors[d], (place[tuple(sorted((t, round(x, 9)) for t, x in vectors[d].items()))], labels[d])), labels[d]) for d in known if vectors[d])
    y = np.array([b for _, b in pairs], float)
    mean = lambda i, j: y[i : j + 1].mean()
    fit = [max(min(mean(i, j) for j in range(k, len(y))) for i in range(k + 1)) for k in range(len(y))]
    pools = []
    for (x, label), f in zip(pairs, fit, strict=True):
        if not pools or f > pools[-1][0] + 1e-12:
            pools.append([f, [], []])
        pools[-1][1].append(x)
        pools[-1][2].append(label)
    xs, ys = [np.mean(p[1]) for p in pools], [(sum(p[2]) + 0.05) / (len(p[2]) + 0.1) for p in pools]
    for r in rows:
        value = vote(vectors[r.doc_id])
        want = float(np.interp(value, xs, ys)) if value is not None else (sum(bare) + prior) / (len(bare) + 1)
        assert abs(r.score - want) < 1e-3 and (r.predicted == int(want >= 0.7) or abs(want - 0.7) < 1e-3)


def test_copies_of_examples_are_found(spark):
    """A text without any enriched term finds the example it copies."""
    docs = [(k, " ".join(f"w{(k * 31 + j * j) % 400}" for j in range(30))) for k in range(120)] + [(500, " ".join(f"w{(7 * 31 + j * j) % 400}" for j in range(30)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(100)], "doc_id long, toxic int")
    found = {r.doc_id: r.evidence for r in toxicity.toxicity(df, labels).collect()}
    assert found[500][0].doc_id == 7 and abs(found[500][0].cosine - 1) < 1e-6


def test_odd_rows(spark):
    docs = [(k, ("vile " if k % 4 == 0 else "fine ") + " ".join(f"w{(k * 7 + j) % 50}" for j in range(9)), "x") for k in range(200)]
    docs += [(900, None, "x"), (901, "", "x"), (902, "vile", "x"), (902, "vile", "x"), (903, "word " * 50000 + "vile", "x"), (None, "vile", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    got = [(r.doc_id, r.score, r.predicted) for r in toxicity.toxicity(df, labels).collect()]
    assert len(got) == len(docs) and all(0 <= s <= 1 and not math.isnan(s) for _, s, _ in got)
    by = {d: p for d, _, p in got}
    assert by[902] == by[903] == by[None] == 1 and by[900] == by[901] == by[1] == 0
    assert toxicity.toxicity(df, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.toxicity(df.limit(0), labels).count() == 0
