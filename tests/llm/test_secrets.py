import hashlib
import random
import re

import pytest

from nearlabel.llm import queries, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(("assign", "access", "hex")[k], a, z) for a, k, z in sorted(found)]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_secrets(spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_assign for r in rows)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in want).encode()).hexdigest()
        assert {f"{k}:{a}:{z}" for k, a, z in want} <= set(r.spans.split(","))


@pytest.mark.parametrize("size", [1, 50, 1 << 22])
def test_fuzz_against_brute_force(size, monkeypatch):
    monkeypatch.setattr(secrets, "SEGMENT_BYTES", size)
    rnd = random.Random(3)
    parts = ["token", "Pass", "word", "passwd", "api_key", "APIKEY", "=", ":", " ", "'", "abcdefgh", "AKIA", "AKIAABCD", "Z9" * 6, "0a" * 16, "ſecret", "é", "secret", "\n", "ghp_" + "a1" * 18]
    texts = [None, ""] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    base = {r.kind for r in secrets.BASE_RULES}
    got = secrets.Scanner().scan(texts)
    assert [[s for s in spans if s[0] in base] for spans in got] == [brute(t) for t in texts]
    assert any(s[0] == "git_token" for spans in got for s in spans)


def test_queries_are_necessary_conditions():
    for pattern in ("ab?cde", "(foo|bar)+x", "abc|d", "x(abc){2}y", "[abc]def", "a.cdef", "(?:ab)*cdefg", "^abcd$"):
        query = secrets.trigram_query(pattern)
        for text in ("abcde", "acde", "foobarx", "abc", "d", "xabcabcy", "bdef", "azcdef", "cdefg", "abcd"):
            if re.search(pattern, text):
                assert any(all(t in text for t in need) for need in query)
    assert secrets.trigram_query("[0-9a-f]{32,}") == secrets.ANY
    assert secrets.trigram_query("abc|d") == secrets.ANY


def test_private_keys_go_whole():
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\nQUJD\nREVG==\n-----END RSA PRIVATE KEY-----"
    texts = [f"a {key} b {key}", "-----BEGIN PRIVATE KEY----- open", f"-----BEGIN PRIVATE KEY-----\nx\n{key}"]
    clean = [secrets.redact_text(t, s) for t, s in zip(texts, secrets.Scanner().scan(texts), strict=True)]
    assert clean == ["a [private_key] b [private_key]", "[private_key] open", "[private_key]\nx\n[private_key]"]


def test_odd_tables(spark, monkeypatch):
    """Clashing columns, very long texts, empty tables."""
    monkeypatch.setattr(secrets, "STEP", 1000)
    long = "word " * 300_000 + "token=abcdefgh12 " + "z" * 200_000
    df = spark.createDataFrame([(1, long, "x"), (None, None, "y"), (2, "", "z")], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.text, r.spans) for r in df.withColumn("text", secrets.redact(secrets.F.col("text"))).collect()}
    assert got == {1: (long.replace("token=abcdefgh12", "[assign]"), "x"), None: (None, "y"), 2: ("", "z")}
    found = {r.doc_id: r.spans for r in df.withColumn("spans", secrets.find_secrets(secrets.F.col("text"))).collect()}
    assert [tuple(s) for s in found[1]] == [("assign", 1_500_000, 1_500_016)] and found[None] == found[2] == []
    none = spark.createDataFrame([], "doc_id long, text string")
    assert none.select(secrets.find_secrets(secrets.F.col("text"))).collect() == none.select(secrets.redact(secrets.F.col("text"))).collect() == []


def test_redaction(spark):
    rows = [(1, "a token = 'abcdefgh12' b"), (2, None), (3, "clean"), (1, "a token = 'abcdefgh12' b"), (4, "password=" + "0a" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", secrets.find_secrets(secrets.F.col("text")))
    got = [(r.doc_id, r.text) for r in df.withColumn("text", secrets.redact(secrets.F.col("text"))).collect()]
    assert sorted(got, key=str) == sorted([(1, "a [assign]' b"), (2, None), (3, "clean"), (1, "a [assign]' b"), (4, "[assign]")], key=str)
    assert df.limit(0).count() == 0
