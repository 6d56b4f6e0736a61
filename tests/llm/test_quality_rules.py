import re
from collections import Counter

import duckdb
import pytest

from nearlabel.llm import quality_rules as q
from nearlabel.llm import queries

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SPACE = r"\x20\x09-\x0D"


def brute(text):
    """The five counts, whether a base rule rejects the text, whether it is kept."""
    text = text or ""
    w = re.findall(f"[^{SPACE}]+", text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACE}]", x)]
    n, chars, symbols, dup = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    base = n < 20 or 100 * len(covered) > 30 * n
    letters = sum(any(c.isalpha() for c in x) for x in w)
    bad = base or 10 * symbols > n or chars < 3 * n or chars > 12 * n or 10 * letters < 8 * n or 2 * dup > len(lines)
    return n, chars, symbols, dup, len(covered), base, not bad


WORDS = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
TEXTS = [
    None, "", " \n\t\r\x0b\x0c ", "one", " ".join("abcdefg"), WORDS, WORDS[:400] + " " + WORDS[:400], "same " * 30, ("a b c d e f g h " * 2).strip(), "a b c d e f g h i " * 3,
    "line of words here\n" * 12, "\n\n".join([WORDS[:80]] * 3), "é😀 ünï " * 11, "x* y# z$ " * 20, "1 22 333 " * 30, "supercalifragilistic " * 25, WORDS + "\n" + WORDS[100:500] + "\x0bend", " ".join(["no", "break"]) + " tail", "a b " * 20,
    WORDS * 60, " ".join(["p", "q"] * 4 + [f"z{i}" for i in range(30)] + ["p", "q"] * 4), "r s t u v w x y r s t u v w x y " + WORDS[:200],
]


def test_counts_and_verdict(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    rows = q.judged(df, COUNTS).collect()
    assert {r.doc_id: (*[r[c] for c in COUNTS], r.base_failed, r.kept) for r in rows} == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert all((r.failed is None) == r.kept for r in rows)


def test_metrics_as_columns_or_inside_branches(spark):
    """The verdict doesn't depend on the order of rules, nor on where metrics are computed; names that clash do no harm."""
    df = spark.createDataFrame([(i, t, -1, "no", True) for i, t in enumerate(TEXTS)], "doc_id int, text string, n_words int, failed string, kept boolean")
    want = {i: brute(t)[-1] for i, t in enumerate(TEXTS)}
    for order in (q.RULES, q.RULES[::-1], None):
        out = q.cascade(df, order=order)
        assert out.columns == df.columns and {r.doc_id: r.kept for r in out.collect()} == want
    assert all(r.n_words == -1 for r in out.collect())


def test_order_by_rejection_per_cost():
    estimates = [q.Estimate("few_words", 1.0, 0.1), q.Estimate("repeated_words", 10.0, 0.5), q.Estimate("symbols", 0.0, 0.2), q.Estimate("letters", 1.0, 0.0)]
    rules = [r for r in q.RULES if r.name in {e.name for e in estimates}]
    assert [r.name for r in q.ordered(rules, estimates)] == ["symbols", "few_words", "repeated_words", "letters"]


def test_short_circuit(spark):
    """What a rule rejects never reaches the next one: a metric that fails on it isn't asked."""
    boom = q.Rule("boom", lambda m: q.F.raise_error(q.F.lit("asked")).cast("boolean"))
    df = spark.createDataFrame([("few",)], "text string")
    assert q.cascade(df, order=(q.RULES[0], boom)).first().failed == "few_words"
    with pytest.raises(Exception, match="asked"):
        q.cascade(df, order=(boom, q.RULES[0])).collect()


def test_estimates(spark):
    df = spark.createDataFrame([("x " * 5,), (WORDS,), (None,), ("y" * (q.SAMPLE_BYTES + 1),)], "text string")
    found = {e.name: e for e in q.estimate(df, q.RULES, [])}
    assert abs(found["few_words"].rejected - 2 / 3) < 1e-9 and all(e.cost >= 0 for e in found.values())
    assert all(e.rejected == 0 for e in q.estimate(df.limit(0), q.RULES, []))
    assert q.judged(df.limit(0).withColumn("doc_id", q.F.lit(1)), COUNTS).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op11_quality_cascade"])
    df = queries.op11_quality_cascade(spark, sf)
    assert df.columns == want.columns and sorted(map(tuple, df.collect())) == sorted(want.fetchall())
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
