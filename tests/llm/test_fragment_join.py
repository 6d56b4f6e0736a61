import random
import re

import numpy as np
import pyarrow as pa
import pytest

from nearlabel.llm import fragment_join as fj
from nearlabel.llm import queries


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))}


def brute(docs, n, num, den):
    sets = {d: shingles(t, n) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted((d for d in sets if sets[d]), key=lambda d: len(sets[d]))
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a]) * den < len(sets[b]) * num:
                break
            common = len(sets[a] & sets[b])
            if common * den >= (len(sets[a]) + len(sets[b]) - common) * num:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def made(seed, groups=25):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "é"]
    texts = [None, "", " \t\n", "one", "One two", "one two"]
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 8, 20, 60, 150, 400]))]
        for _ in range(rnd.randint(1, 14)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append(rnd.choice([" ", "\n"]).join(w).upper() if rnd.random() < 0.2 else " ".join(w))
            base = w if rnd.random() < 0.4 else base
    return list(enumerate(texts + texts[:9]))


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_against_brute_force(spark, n, num, monkeypatch):
    monkeypatch.setattr(fj, "PART_BYTES", 500)
    docs = made(n)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n long").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in fj.near_duplicates(df, n, num).collect()}
    want = brute(docs, n, num, 100)
    assert got == want and len({c for _, c in want.values()}) < len(docs) - 40


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(fj, "BLOCK", 20)
    monkeypatch.setattr(fj, "COLUMNS", 7)
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(300)}" for _ in range(120)]
    docs = []
    for k in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(40)}"
        docs.append((k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in fj.near_duplicates(df, 3, 90).collect()}
    want = brute(docs, 3, 90, 100)
    assert got == want and 10 < len({c for _, c in want.values()}) < 140


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_fragment_join(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(docs, 3, 90, 100)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fj.near_duplicates(df).count() == 0


def some_order(rng):
    steps = rng.integers(0, 40, fj.SLOTS).astype(np.uint8)
    return fj.Order(steps, np.bincount(steps, minlength=256).astype(float))


@pytest.mark.parametrize("num", [80, 90])
def test_common_key_for_every_linked_pair(num):
    rng = np.random.default_rng(num)
    order = some_order(rng)
    for _ in range(400):
        size = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        b = a.copy()
        while True:
            nxt = np.unique(np.append(np.delete(b, rng.integers(len(b))), rng.integers(0, 1 << 63, dtype=np.uint64)) if rng.random() < 0.5 else np.append(b, rng.integers(0, 1 << 63, dtype=np.uint64)))
            common = len(np.intersect1d(a, nxt))
            if common * 100 < (len(a) + len(nxt) - common) * num:
                break
            b = nxt
        keys, counts = fj.firsts(np.concatenate([a, b]), np.array([len(a), len(b)]), order, num, 100)
        assert counts.tolist() == [len(x) - -(-num * len(x) // 100) + 1 for x in (a, b)]
        assert set(keys[: counts[0]].tolist()) & set(keys[counts[0] :].tolist())


def test_order():
    rng = np.random.default_rng(3)
    order = some_order(rng)
    grams = np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2))
    sizes = np.bincount(np.sort(rng.integers(0, 90, len(grams))), minlength=90)
    keys, counts = fj.firsts(grams, sizes, order, 80, 100)
    for k, (z, n) in enumerate(zip(np.cumsum(sizes), np.cumsum(counts), strict=True)):
        own = sorted(grams[z - sizes[k] : z].tolist(), key=lambda g: (order.steps[g >> 42], g))
        assert keys[n - counts[k] : n].tolist() == own[: counts[k]]
    frag = order.fragment(grams)
    ranked = np.array(sorted(range(len(grams)), key=lambda i: (order.steps[int(grams[i]) >> 42], grams[i])))
    assert (np.diff(frag[ranked]) >= 0).all() and np.bincount(frag, minlength=fj.FRAGMENTS).min() > len(grams) / fj.FRAGMENTS / 2
    assert (fj._unpacked(fj._packed(np.arange(300))) == np.arange(300)).all()


def test_marks_differ_no_more_than_sets():
    """The bits in which marks differ, folded where sizes cross a power of two, are at most the grams that differ."""
    rng = np.random.default_rng(9)
    for size in (3, 100, 127, 129, 500, 1030):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = np.concatenate([a[size // 9 :], rng.integers(0, 1 << 63, size // 7, dtype=np.uint64)])
        words, n = fj.marks(np.concatenate([a, b]), np.array([len(a), len(b)]))
        x, y = words[: n[0]], words[n[0] :]
        x, y = (np.bitwise_xor(*np.split(v, 2)) if len(v) > len(w) else v for v, w in ((x, y), (y, x)))
        assert len(x) == len(y) and np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b)) and np.bitwise_count(x).sum() % 2 == len(a) % 2


@pytest.mark.parametrize("few", [0, 64])
def test_search_by_marks(few, monkeypatch):
    """Buckets in any batches: the groups that near pairs of different labels make, one by one and crowded alike."""
    monkeypatch.setattr(fj, "FEW", few)
    rng = np.random.default_rng(6)
    rows = []
    for key in range(40):
        base = rng.integers(0, 1 << 63, 120, dtype=np.uint64) * np.uint64(2)
        for _ in range(int(rng.integers(1, 12))):
            own = base.copy()
            own[: int(rng.integers(0, 60))] = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
            own = np.unique(own)
            mark, _ = fj.marks(own, np.array([len(own)]))
            rows.append((key, 0, len(rows), len(own), len(rows) if rng.random() < 0.7 else -1, mark.view(np.int64).tolist()))
    rows.sort(key=lambda r: (r[0], r[3]))
    table = pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("key", pa.int64()), ("task", pa.int64()), ("cid", pa.int64()), ("n", pa.int64()), ("label", pa.int64()), ("mark", pa.list_(pa.int64()))))})

    def groups(pairs):
        root = list(range(len(rows)))
        for a, b in pairs:
            a, b = min(root[a], root[b]), max(root[a], root[b])
            root = [a if r == b else r for r in root]
        return root

    want = []
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[2] < y[2] and x[4] != y[4] and min(x[3], y[3]) * 100 >= max(x[3], y[3]) * 80:
                u, v = (np.array(m[5]).view(np.uint64) for m in (x, y))
                u, v = (np.bitwise_xor(*np.split(w, 2)) if len(w) > len(z) else w for w, z in ((u, v), (v, u)))
                if int(np.bitwise_count(u ^ v).sum()) * 180 <= (x[3] + y[3]) * 20:
                    want.append((x[2], y[2]))
    for size in (1, 7, 1000):
        found = pa.Table.from_batches(list(fj._searched(80, 100)(iter(table.to_batches(max_chunksize=size)))))
        assert groups(zip(found.column("src").to_pylist(), found.column("dst").to_pylist(), strict=True)) == groups(want)
    assert len(set(groups(want))) < len(rows) - 30


@pytest.mark.parametrize("bits", [10, 64])
def test_sorting_by_document_and_keys(bits):
    rng = np.random.default_rng(1)
    doc = np.sort(rng.integers(0, 5, 1000))
    low = rng.integers(0, 4, 1000).astype(np.uint64)  # told apart by their last bits alone
    high = rng.integers(0, 3, 1000).astype(np.uint8)
    got = fj._by(doc, [(high, 8), (low, 64)], 5)
    assert [(doc[i], high[i], low[i]) for i in got] == sorted(zip(doc, high, low, strict=True))


def test_one_document_of_each_group_stays(spark):
    """Repeated rows and keys, null keys and clashing columns: one row of each group, rows without words all but copies."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "a"), (1, text, "a"), (2, text.upper(), "b"), (2, "other words that stand alone here", "c"), (None, text + " x", "d"), (None, "only null", "e"), (None, "only  null", "f"), (3, None, "g"), (3, None, "g"), (4, "", "h"), (5, "", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = sorted(map(tuple, fj.without_duplicates(df, 5, 80).collect()), key=str)
    null = [r for r in got if r[1] and r[1].startswith("only")]
    assert len(null) == 1
    assert [r for r in got if r not in null] == sorted([(1, text, "a"), (2, "other words that stand alone here", "c"), (3, None, "g"), (4, "", "h"), (5, "", "i")], key=str)
    assert fj.without_duplicates(df.limit(0)).count() == 0
